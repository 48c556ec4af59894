"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.llm import conversation_repair, exact_dedup, language_id, lm_scoring, mixing, phrases, quality_classifier, quality_rules, secret_scan, sentence_pieces, simhash, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The measures by rows: one per word, window and line.
QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] l from d),
g as (select doc_id, unnest(range(1, len(w) - 1)) i, w from w where len(w) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) n from g),
r as (select doc_id, count(distinct p) n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) p from h where n > 1) group by doc_id),
m as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
      coalesce(n_repeat_words, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
      len(regexp_extract_all(t, '\p{Lu}{3,}'))::bigint n_shouted, length(regexp_replace(t, '[^!]+', '', 'g'))::bigint n_exclaims
      from w left join r using (doc_id)),
f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
      + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (10 * n_shouted > 3 * n_words)::bigint + 32 * (10 * n_exclaims > n_words)::bigint
      + 64 * (word_chars < 2 * n_words)::bigint + 128 * (word_chars > 15 * n_words)::bigint
      + 256 * (100 * n_repeat_words > 30 * n_words)::bigint + 512 * (20 * n_symbols > n_words)::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 base_failed, failed & 255 = 0 kept, failed from f
"""


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@query(QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger of all documents, judged by the standard policy."""
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2-standard")
    base = quality_rules.apply_policy(judged, "v1-base", "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("""
with p as (select page_id, encode(coalesce(html, '')) b, coalesce(html, '') h from pages),
g as (select page_id, h, octet_length(b)::bigint payload_bytes, sha1(h) payload_digest, max(page_id) over (partition by h) top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end refers_to from g
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.BASE], F.sha2(secret_scan.as_text(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.as_text(F.col("spans")).alias("spans"))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def _level_sql(name: str, path: str, weight: str, parent: str, parent_key: str) -> str:
    """One allocation of the budget tree: shares by weight, none above its cap, whole tokens."""
    keys = path.split(", ")
    over = f"partition by {parent_key}" if parent_key else ""
    budget = f"(select budget from {parent})" if not parent_key else "p.given"
    join = f"join {parent} p using ({parent_key})" if parent_key else ""
    return f"""
{name}_n as (select {path}, sum(supply) * {mixing.MAX_EPOCHS} cap, {keys[-1]} nm, {weight} w from leaves group by all),
{name}_b as (select n.*, {budget} budget from {name}_n n {join}),
{name}_r as (select *, coalesce(sum(cap) over ({over} order by cap / w, cap, nm rows between unbounded preceding and 1 preceding), 0) cb,
  sum(w) over ({over} order by cap / w, cap, nm rows between current row and unbounded following) wr from {name}_b),
{name}_f as (select *, (budget - cb) * w >= cap * wr as filled from {name}_r),
{name}_s as (select *, case when filled then cap else ((budget - sum(case when filled then cap else 0 end) over ({over})) * w)
  // sum(case when filled then 0 else w end) over ({over}) end share from {name}_f),
{name}_m as (select *, budget - sum(share) over ({over}) missing,
  sum((share < cap)::int) over ({over} order by cap / w, cap, nm rows between unbounded preceding and current row) slack from {name}_s),
{name} as (select {path}, (share + (share < cap and slack <= missing)::int)::bigint given from {name}_m),"""


def _case(column: str, names: dict, other) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v!r}" for k, v in names.items()) + f" else {other!r} end"


MIX_SQL = f"""
with r as (select doc_id, {_case("coalesce(source, 'unknown')", mixing.DOMAINS, mixing.OTHER_DOMAIN)} "domain", coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source,
  len([x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''])::bigint n_tokens from documents),
leaves as (select "domain", lang, source, sum(n_tokens)::bigint supply from r group by all),
top as (select least(sum(supply) * {mixing.SHARE_PERCENT} // 100, sum(supply) * {mixing.MAX_EPOCHS}) budget from leaves),
{_level_sql("l1", '"domain"', _case('"domain"', mixing.WEIGHTS["domain"], 1), "top", "")}
{_level_sql("l2", '"domain", lang', _case("lang", mixing.WEIGHTS["lang"], 1), "l1", '"domain"')}
{_level_sql("l3", '"domain", lang, source', "1", "l2", '"domain", lang')}
plan as (select * from leaves join l3 using ("domain", lang, source) where given > 0),
wanted as (select "domain", lang, source, unnest(range(0, (given - 1) // supply + 1)) epoch, supply, given from plan),
placed as (select doc_id, "domain", lang, source, epoch::int epoch, n_tokens, least(supply, given - epoch * supply) target,
  md5('{mixing.SEED}:' || epoch || ':' || doc_id) k from r join wanted using ("domain", lang, source)),
run as (select *, sum(n_tokens) over (partition by "domain", lang, source, epoch order by k range between unbounded preceding and current row)
  - sum(n_tokens) over (partition by "domain", lang, source, epoch, k) ahead from placed)
select doc_id, "domain", lang, source, epoch, n_tokens, least(n_tokens, target - ahead)::bigint used_tokens from run where ahead < target
"""


@query(MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken by the budget tree, with the epoch and the tokens used."""
    return mixing.select(table(spark, sf_dir, "documents"))


@query()
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and whether they decode to its text."""
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


@query("""
with d as (select doc_id, coalesce(text, '') t from documents), g as (select doc_id, t, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size from d)
select doc_id, keep_id, group_size::bigint group_size, doc_id = keep_id kept, sha256(t) text_sha256 from g
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every encoded length: documents and tokens over it, tokens kept by truncating there, and its quantile."""
    return token_counts.limits(token_counts.histogram(table(spark, sf_dir, "documents")))


#: Table and text of the checksum CRC-32, which DuckDB does not have.
CRC_TABLE = ("(select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
             "lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) tab)")


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, where `tab` of CRC_TABLE is in reach."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), "
            "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))")


_GRAMS = "unnest(list_transform(range(1, length(p) - level + 2), lambda i: substr(p, i, level))) gram"
_SIZES = f"(select unnest(range(1, {language_id.LONGEST + 1})) level)"
LANGUAGE_SQL = f"""
with d as (select doc_id, lang, text, {crc_sql("coalesce(doc_id::varchar, '')")} % {language_id.FOLDS} = {language_id.HELD_OUT} held_out from documents, {CRC_TABLE}),
w as (select doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*')) word from d),
c as (select lang, word, count(*) n from w where not held_out and lang is not null group by all),
g as (select 0 as level, lang, word gram, n from c union all
  select level, lang, gram, sum(n) from (select level, lang, n, {_GRAMS} from (select *, case when level > 1 then ' ' || word || ' ' else word end p from c, {_SIZES})) group by all),
e as (select level, lang, gram, log10(n / total) + {-language_id.PENALTY} v from (select *, sum(n) over (partition by level, lang) total from g)
  where n * ({language_id.KEPT} // (select count(distinct lang) from c)) >= total),
langs as (select lang, sum(n) total from c group by lang),
kinds as (select distinct word from w),
wg as (select word, 0 as level, word gram from kinds union all
  select word, level, {_GRAMS} from (select *, case when level > 1 then ' ' || word || ' ' else word end p from kinds, {_SIZES})),
k as (select * from wg semi join e using (level, gram)),
b as (select word, case when min(level) = 0 then 0 else max(level) end as level from k group by word),
r as (select word, level, gram, count(*) over (partition by word) n from k join b using (word, level)),
v as (select word, lang, sum(v / n) v from r join e using (level, gram) group by all),
dw as (select doc_id, word, count(*) times from w group by all),
dn as (select doc_id, sum(times) known from dw semi join b using (word) group by doc_id),
dv as (select doc_id, lang, sum(times * v) total from dw join v using (word) group by all),
m as (select doc_id, lang, round(total / known, 9) mean from dv join dn using (doc_id)),
s as (select doc_id, arg_min(lang, (-mean, lang)) lang_pred, max(mean) top from m group by doc_id),
p as (select doc_id, 1 / sum(10 ** (coalesce(mean, 0) - top)) score from (select doc_id, lang, top from s, langs) left join m using (doc_id, lang) group by doc_id)
select doc_id, held_out, coalesce(lang_pred, case when regexp_matches(text, '\\p{{L}}') then (select arg_min(lang, (-total, lang)) from langs) end, '{language_id.UNKNOWN}') lang_pred,
  round(coalesce(score, case when regexp_matches(text, '\\p{{L}}') then 1 / (select count(*) from langs) end, 0), 6) score from d left join s using (doc_id) left join p using (doc_id)
"""


@query(LANGUAGE_SQL)
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


PHRASE_SQL = f"""
with d as (select doc_id, row_number() over () k, coalesce(lang, '{phrases.UNKNOWN}') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, [x for x in regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+') if x <> ''] w from d),
one as (select lang, x word, count(*) f from (select lang, unnest(w) x from p) group by all),
g as (select lang, w[i:i + m - 1] ws, m from (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from p, (select unnest([2, 3]) m))),
c as (select lang, ws, m, count(*) a from g group by all having count(*) >= {phrases.LEAST}),
inner_ as (select lang, ws[1:2] ws, a from c where m = 3 union all select lang, ws[2:3], a from c where m = 3),
gone as (select distinct c.lang, c.ws from c join inner_ i on i.lang = c.lang and i.ws = c.ws and 100 * i.a >= {phrases.COVERED} * c.a where c.m = 2),
kept as (select * from c anti join gone using (lang, ws)),
parts as (select lang, [word] ws, f from one union all select lang, ws, a from c where m = 2),
cuts as (select k.lang, k.ws, k.a, x.f l, y.f r, n.i, 1000000::hugeint * k.a * k.a // (x.f::hugeint * y.f) score from kept k
  join (select unnest([1, 2]) i) n on n.i < k.m join parts x on x.lang = k.lang and x.ws = k.ws[1:n.i] join parts y on y.lang = k.lang and y.ws = k.ws[n.i + 1:k.m]),
low as (select * from cuts qualify row_number() over (partition by lang, ws order by score, i) = 1),
r as (select *, array_to_string(ws, ' ') phrase, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(ws, ' '))) rank from low)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from r join (select lang, sum(f) n from one group by lang) using (lang) where rank <= {phrases.TOP}
"""


@query(PHRASE_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


# Forward over the rows: for each state the cheapest edits so far, the ASCII-least of them, and the text they lead to.
# (state, next one asked for): 0 start, 1 after system, 2 after user, 3 after assistant.
CONVERSATION_SQL = f"""
with recursive r as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') t,
    {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 lot from conversations, {CRC_TABLE}),
m as (select conv_id, turn, case when lot = 4 then 'user' else role end role, case lot when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t,
    unnest(case when lot = 3 then [1, 2] else [1] end) copy from r where lot <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(t), copy) i,
    right(rtrim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) e from m),
f as (select conv_id, turn, role, t, i, left(role, 1) c, case when e = '' then 1 when row_number() over (partition by conv_id, role, t order by i) > 1 then 2 when e not in ('.', '!', '?') then 3 else 0 end k,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) pair from o),
moves as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(s, c, z)),
wanted as (select * from (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) v(s, role, z)),
pre as (select s, s via, '' ins, '' add, 0 w from wanted union all select s, z, 'I', role || ':', 2 from wanted),
steps as (
  select s, ins, add, w + 3 w, 'D' edit, null::varchar as c, via z, null::varchar as role from pre union all
  select p.s, ins, add, w, 'K', c, z, null::varchar from pre p join moves m on m.s = via union all
  select p.s, ins, add, w + 2, 'R', null::varchar, z, role from pre p join wanted n on n.s = via),
ways as (
  select conv_id, 0::bigint i, 0 s, 0::bigint cost, '' audit, '' body from (select distinct conv_id from conversations) union all
  select conv_id, i, s, cost, audit, body from (
    select a.conv_id, f.i, z s, a.cost + w + case when edit <> 'D' and f.k = 3 then 1 else 0 end cost, a.audit || ins || edit audit,
      a.body || case when ins <> '' then case when a.audit in ('', repeat('D', length(a.audit))) then '' else chr(10) end || add else '' end
        || case when edit = 'D' then '' else case when ins = '' and a.audit in ('', repeat('D', length(a.audit))) then '' else chr(10) end || coalesce(x.role, f.role) || ':' || f.t end body
    from ways a join f on f.conv_id is not distinct from a.conv_id and f.i = a.i + 1 join steps x on x.s = a.s and (x.c is null or x.c = f.c) and (edit = 'D' or f.k not in (1, 2)))
  qualify row_number() over (partition by conv_id, i, s order by cost, audit) = 1),
ends as (select * from (values (0, '', '', 0), (3, '', '', 0), (2, 'I', 'assistant:', 2), (1, 'II', 'user:' || chr(10) || 'assistant:', 4)) v(s, ins, add, w)),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (k = 1)::bigint blank, count(*) filter (k = 2)::bigint "duplicate",
    count(*) filter (k = 3)::bigint truncated, count(*) filter (pair not in ('su', 'ua', 'au'))::bigint illegal, max(i) i from f group by conv_id),
best as (select a.conv_id, a.i, cost + w cost, audit || ins audit, body || case when ins <> '' and audit not in ('', repeat('D', length(audit))) then chr(10) else '' end || add body
  from ways a join ends using (s) left join n on n.conv_id is not distinct from a.conv_id where a.i = coalesce(n.i, 0)
  qualify row_number() over (partition by a.conv_id order by cost + w, audit || ins) = 1)
select b.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce("duplicate", 0)::bigint "duplicate", coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, cost::bigint cost, audit, sha256(body) repaired_sha256 from best b left join n on n.conv_id is not distinct from b.conv_id
"""


@query(CONVERSATION_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation."""
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations")), whole=False)
