"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words before every space and around line ends, where no piece of the model goes across. Each
distinct word of the corpus is segmented once: its substrings up to the longest piece are exploded and joined to the
piece table (bounded by the vocabulary, so it is broadcast), which gives the edges of the word's lattice; the edges are
grouped by word and folded by `aggregate`. The result is the set of places where the word is cut, as bits of a long.

The fold depends on the model. For unigram models it is Viterbi: best sum of piece scores up to each place. The
public model here is of the BPE kind, for which the best sum is not what the model defines; its fold goes through the edges in
order of score and start and joins two neighbours wherever an edge spans just these. Should a join make an edge of better
score possible after its turn, the word is marked and merged in a queue, as are words over LONGEST characters. Both give
what the model's own library gives. Characters outside the model become byte pieces.

Documents then look up their words. The HEAD most frequent words travel with the job, so that a document
becomes a list of word numbers; all other words are joined to the dictionary and meet their document by its key.

Defined results: a null or empty text has no pieces; an empty table gives an empty result; repeated rows are encoded each;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.llm.common import Shipped
from kinepair.sources.staging import staged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Most characters of a word that is folded; places are bits of a long.
LONGEST = 60
#: Most frequent words sent along: at most so many.
HEAD = 600_000
#: Bytes of text per task of the lattice.
TASK_BYTES = 4 << 20
SPACE, CUT = "▁", "\x1f"


class Model:
    """Pieces of a SentencePiece model: score order, ids and bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_from: int | None, unknown: int = 0, kind: str = "bpe"):
        """`pieces` maps a piece to id and score; `bytes_from` is the id of the byte piece 0."""
        self.pieces, self.bytes_from, self.unknown, self.kind = pieces, bytes_from, unknown, kind
        # Better scores first; equal scores share a place.
        place = {s: i for i, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        self.order = {p: place[s] for p, (_, s) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        if any(SPACE in p.lstrip(SPACE) or len(p) > 1 and ("\n" in p or CUT in p) for p in pieces):
            raise ValueError("a piece goes across a space or a line end")
        self.late = {p for p in pieces if len(p) > 1} & self._overtaken()

    def _overtaken(self) -> set[str]:
        """Pieces that can complete a piece of equal or better score."""
        found = set()
        for whole, at in self.order.items():
            for k in range(1, len(whole)):
                a, b = whole[:k], whole[k:]
                if (len(a) == 1 or a in self.order) and (len(b) == 1 or b in self.order):
                    found |= {x for x in (a, b) if len(x) > 1 and self.order[x] >= at}
        return found

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            data = f.read()
        read = proto.ModelProto()
        read.ParseFromString(data)
        spec = read.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models without normalisation are supported")
        kinds = proto.ModelProto.SentencePiece
        usual = {p.piece: (i, p.score) for i, p in enumerate(read.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        first = next((i for i, p in enumerate(read.pieces) if p.type == kinds.BYTE), None)
        unknown = next(i for i, p in enumerate(read.pieces) if p.type == kinds.UNKNOWN)
        kind = "unigram" if read.trainer_spec.model_type == 1 else "bpe"
        del sentencepiece
        return cls(usual, first, unknown, kind)

    def spelled(self, char: str) -> list[int]:
        """Ids of a character outside the pieces."""
        return [self.unknown] if self.bytes_from is None else [self.bytes_from + b for b in char.encode()]

    def merge(self, word: str) -> list[int]:
        """Encodes a word of any length by merging neighbours, best score first, then leftmost."""
        parts, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        queue: list[tuple[int, int, str]] = []

        def offer(i):
            if i >= 0 and right[i] < len(parts):
                joined = parts[i] + parts[right[i]]
                if joined in self.order:
                    heapq.heappush(queue, (self.order[joined], i, joined))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = right[i] if parts[i] else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], right[i] = joined, "", right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [x for p in parts if p for x in ([self.pieces[p][0]] if p in self.pieces else self.spelled(p))]

    def viterbi(self, word: str) -> list[int]:
        """Encodes a word of any length by the best sum of scores; ties go to the longer last piece."""
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
        worst = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + self.pieces[word[s:e]][1], s, [self.pieces[word[s:e]][0]]) for s in range(max(0, e - self.longest), e) if word[s:e] in self.pieces]
            if not any(s == e - 1 for _, s, _ in options):
                options.append((best[e - 1][0] + worst, e - 1, self.spelled(word[e - 1])))
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        out, e = [], len(word)
        while e:
            out, e = best[e][2] + out, best[e][1]
        return out

    def encode_word(self, word: str, places: int | None = None) -> list[int]:
        """Ids of a word, cut at the given places, or else from the start."""
        if places is None:
            return self.viterbi(word) if self.kind == "unigram" else self.merge(word)
        out, start, pieces = [], 0, self.pieces
        places >>= 1
        for end in range(1, len(word) + 1):
            if places & 1:
                found = pieces.get(word[start:end])
                if found is None:
                    out += self.spelled(word[start:end])
                else:
                    out.append(found[0])
                start = end
            places >>= 1
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, place, score, late), one row per piece."""
        rows = [(p, i, self.order[p], float(s), p in self.late) for p, (i, s) in self.pieces.items()]
        return spark.createDataFrame(rows, "piece string, id int, place int, score double, late boolean")


def words_of(text: str) -> list[str]:
    """The words of a text: each starts with its spaces, line ends are words of their own; empty ones between are to be skipped."""
    if not text:
        return []
    if text[0] == " " or "  " in text or CUT in text or SPACE in text:
        return _words_of_any(text)
    return (SPACE + text).replace(" ", CUT + SPACE).replace("\n", CUT + "\n" + CUT).split(CUT)


def _words_of_any(text: str) -> list[str]:
    """Spaces in a row belong to the word after them; the separator is a character outside all pieces, and so a word of its own."""
    out: list[str] = []
    for k, part in enumerate((SPACE + text.replace(" ", SPACE)).split(CUT)):
        out += [CUT] * (k > 0)
        fresh = True
        for w in part.replace(SPACE, CUT + SPACE).replace("\n", CUT + "\n" + CUT).split(CUT):
            if w and not fresh and not out[-1].strip(SPACE) and w[0] == SPACE:
                out[-1] += w
            elif w:
                out.append(w)
                fresh = False
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def flush():
        found.pop("", None)
        out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(words_of(text))
            if len(found) > 1_000_000:
                yield flush()
    yield flush()


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, dealt by word; combined per task before the only shuffle."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = docs.select("text").mapInArrow(_count_words, "word string, n long")
    return counted.repartition(max(1, -(-size // TASK_BYTES)), "word").groupBy("word").agg(F.sum("n").alias("n"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def lattice(words: DataFrame, pieces: DataFrame, longest: int, edge: Column, least: int) -> DataFrame:
    """(word, n, size, edges): sorted edges of all pieces of `least` characters or more in words of up to LONGEST characters.

    Explosion, broadcast join and grouping keep the partitioning by word.
    """
    cut = (words.withColumn("size", F.length("word")).where(F.col("size").between(least, LONGEST))
           .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("size") - least)))
           .withColumn("e", F.explode(F.sequence(F.col("s") + least, F.least(F.col("size"), F.col("s") + longest))))
           .withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s"))))
    edges = cut.join(F.broadcast(pieces), "piece")
    return edges.groupBy("word").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(edge)).alias("edges"))


def cut_by_merges(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, places) for BPE models; places are null where the word has to be merged in a queue. Words without edges are left out."""
    # An edge as one number in the order of the fold: place of its score, start, end, and whether it can be overtaken.
    shift = lambda c, k: F.shiftleft(F.col(c).cast("long"), k)
    table = lattice(words, model.table(words.sparkSession), model.longest, shift("place", 13) + shift("s", 7) + shift("e", 1) + F.col("late").cast("long"), 2)
    mark = 1 << 62
    start, end = (lambda x: F.shiftright(x, 7).bitwiseAND(F.lit(63)).cast("int")), (lambda x: F.shiftright(x, 1).bitwiseAND(F.lit(63)).cast("int"))
    def inner(x: Column) -> Column:
        return _bit(end(x)) - _bit(start(x) + 1)
    def joins(places: Column, x: Column) -> Column:
        # Both ends are cuts, and one place between them.
        span = places.bitwiseAND(_bit(end(x) + 1) - _bit(start(x)))
        ends = _bit(start(x)).bitwiseOR(_bit(end(x)))
        return (F.bit_count(span) == 3) & (span.bitwiseAND(ends) == ends)
    def step(places: Column, x: Column) -> Column:
        joined = places.bitwiseAND(F.bitwise_not(inner(x)))
        missed = (x.bitwiseAND(F.lit(1)) == 1) & F.exists("edges", lambda other: (other < x) & joins(joined, other))
        return F.when(joins(places, x), F.when(missed, joined.bitwiseOR(F.lit(mark))).otherwise(joined)).otherwise(places)
    folded = table.withColumn("places", F.aggregate("edges", _bit(F.col("size") + 1) - 1, step))
    return folded.select("word", "n", F.when(F.col("places") < F.lit(mark), F.col("places")).alias("places"))


def cut_by_viterbi(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, places) for unigram models; places are null where no path of pieces spells the word."""
    table = lattice(words, model.table(words.sparkSession), model.longest, F.struct("s", "e", "score"), 1)
    best = "array<struct<score: double, s: int>>"
    def step(done: Column, e: Column) -> Column:
        ways = F.filter("edges", lambda x: (x["e"] == e) & F.get(done, x["s"])["score"].isNotNull())
        # Ties go to the longer last piece.
        top = F.array_max(F.transform(ways, lambda x: F.struct((F.get(done, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("s"))))
        return F.concat(done, F.array(F.struct(top["score"].alias("score"), (-top["s"]).alias("s")))).cast(best)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"))).cast(best)
    folded = table.withColumn("done", F.aggregate(F.sequence(F.lit(1), F.col("size")), first, step))
    # Back from the end: a place is a cut if the path so far starts there.
    state = "struct<at: int, places: long>"
    def back(path: Column, e: Column) -> Column:
        return F.when(path["at"] == e, F.struct(F.get("done", e)["s"].alias("at"), path["places"].bitwiseOR(_bit(e)).alias("places")).cast(state)).otherwise(path)
    path = F.aggregate(F.sequence(F.col("size"), F.lit(1), F.lit(-1)), F.struct(F.col("size").alias("at"), F.lit(1).cast("long").alias("places")).cast(state), back)
    return folded.select("word", "n", F.when(F.get("done", F.col("size"))["score"].isNotNull(), path["places"]).alias("places"))


def dictionary(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, places) of the words that have edges; written."""
    return staged((cut_by_viterbi if model.kind == "unigram" else cut_by_merges)(words, model), "dictionary")


def head_of(table: DataFrame, most: int) -> list[tuple[str, int | None]]:
    """The most frequent words, at most `most` of them, with their places; by frequency, so that common words have small numbers."""
    step = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return []
    found = table.where(step >= least).select("word", "places", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return [*zip(found.column(0).to_pylist(), found.column(1).to_pylist())]


def _numbers(head: Shipped) -> dict[str, int]:
    """Number of each word of the head; the empty word between two cuts is 0."""
    return {w: i for i, w in enumerate(["", *head.get()])}


def _numbered(text: str, number: dict[str, int]) -> tuple[list[int], list[str]]:
    """Numbers of a text's words, those of words outside the head counted on from it; and these words."""
    words = words_of(text)
    found = [*map(number.get, words)]
    if None not in found:
        return found, []
    more: dict[str, int] = {}
    base = len(number)
    for i, v in enumerate(found):
        if v is None:
            found[i] = base + more.setdefault(words[i], len(more))
    return found, [*more]


def _further(head: Shipped):
    """(key, place, word): the words outside the head, by their place in the document's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(head)
        for batch in batches:
            rows = [(k, i, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, w in enumerate(_numbered(t or "", number)[1])]
            for at in range(0, len(rows), 50_000):
                keys, places, words = zip(*rows[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=["key", "place", "word"])

    return run


def _codes(head: Shipped):
    """(key, doc_id, codes, check): the packed word numbers and a checksum of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pack = _numbers(head), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = [pack.compress(np.array(_numbered(t or "", number)[0], dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for t in part.column(2).to_pylist()]
                check = [zlib.crc32(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.binary()), pa.array(check, pa.int64())], names=["key", "doc_id", "codes", "check"])

    return run


def _assemble(ids: Shipped, model: Shipped):
    """Ids of each document from those of its words, decoded again word by word and compared by checksum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unpack = model.get(), zstandard.ZstdDecompressor()
        spell = Decoder(own)
        known = [b"", *ids.get()]
        plain, base = [spell.plain(i) for i in known], len(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found, good = [], []
                for packed, check, more in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    codes = np.frombuffer(unpack.decompress(packed), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().tolist()
                    if more:
                        further = {base + x["place"]: np.array(own.encode_word(x["word"], x["places"]), dtype="<i4").tobytes() for x in more}
                        data = [known[c] if c < base else further[c] for c in codes]
                        further = {c: spell.plain(i) for c, i in further.items()}
                        text = [plain[c] if c < base else further[c] for c in codes]
                    else:
                        data, text = map(known.__getitem__, codes), map(plain.__getitem__, codes)
                    found.append(np.frombuffer(b"".join(data), dtype="<i4"))
                    # The first space was put there by the encoder.
                    good.append(zlib.crc32(b"".join(text)[1:]) == check)
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32())), pa.array(good, pa.bool_())],
                                                 names=["doc_id", "ids", "round_trip"])

    return run


class Decoder:
    """Text of a sequence of ids."""

    def __init__(self, model: Model):
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in model.pieces.items()}
        if model.bytes_from is not None:
            self.bytes_of |= {model.bytes_from + b: bytes([b]) for b in range(256)}
        self.bytes_of.setdefault(model.unknown, b"\xef\xbf\xbd")

    def plain(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        # The first space was put there by the encoder.
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, ids, round_trip: the ids of every whole text, and whether they decode to it.

    A text that holds the escaped space character itself decodes to a space there.
    """
    spark = docs.sparkSession
    model = model or Model.load(MODEL)
    table = dictionary(distinct_words(docs), model)
    head = head_of(table, HEAD)
    words = Shipped(spark, [w for w, _ in head])
    ids = Shipped(spark, [np.array(model.encode_word(w, p), dtype="<i4").tobytes() for w, p in head])
    del head
    # Rows meet their further words by id and text; equal rows share them, so a key's words are a set.
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"), "text")
    further = rows.select("key", "text").mapInArrow(_further(words), "key long, place int, word string")
    more = further.join(table.select("word", "places"), "word", "left").groupBy("key").agg(F.collect_set(F.struct("place", "word", "places")).alias("more"))
    codes = rows.mapInArrow(_codes(words), "key long, doc_id long, codes binary, check long")
    joined = codes.join(more, "key", "left").select("doc_id", "codes", "check", "more")
    return joined.mapInArrow(_assemble(ids, Shipped(spark, model)), "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    ship = Shipped(encoded.sparkSession, model or Model.load(MODEL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Decoder(ship.get())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spell.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
