"""Which rows the language model learns from."""

from kinepair.llm import lm_scoring
from kinepair.llm.common import Shipped


def test_every_training_row_is_learned_from(spark, tmp_path):
    # Rows of a few, half without id; a row is one file, written as it is trained from.
    docs = spark.createDataFrame([(None if i % 2 else i, f"word{i}") for i in range(40)], "doc_id long, text string")
    folder = str(tmp_path)

    class Seen:
        def read(self, texts):
            for text in texts:
                open(f"{folder}/{text.decode()}", "w").close()
            return ([lm_scoring.np.zeros(2, dtype=int) for _ in texts], {}, None)

    lm_scoring.learn(docs, Shipped(spark, Seen()), lm_scoring.np.ones(lm_scoring.SYMBOLS))
    want = {r["text"] for r in docs.where(lm_scoring.fold() != lm_scoring.HELD_OUT).collect()}
    assert {p.name for p in tmp_path.iterdir()} == want
