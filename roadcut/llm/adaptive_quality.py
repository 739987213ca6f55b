"""Quality rules with thresholds from the corpus itself, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.llm import _io

#: Shares and lengths are held in millionths.
ONE = 1_000_000
#: Fences that are broadcast (some 100 bytes each); more are joined by their keys.
FEW = 50_000
_WHITE = "\\\\x20\\\\x09-\\\\x0D"
#: Least and most value that a fence may take: the adaptive threshold moves between them.
FLOOR = {"sym": ONE // 10, "dup": ONE // 2}
CEILING = {"sym": 3 * ONE // 10, "dup": 7 * ONE // 10}
_REPEATS = """transform(array(sort_array(transform(q2.hash, (h, i) -> struct(h, i)))), t ->
  transform(array(sort_array(transform(filter(t, (x, i) -> get(t, i - 1).h <=> x.h OR get(t, i + 1).h <=> x.h), x -> x.i))), p ->
    aggregate(transform(p, (x, k) -> least(8, coalesce(get(p, k + 1), x + 8) - x)), 0, (a, b) -> a + b))[0])[0]"""


def _once(**fields: str):
    """A struct that the optimizer evaluates once a row: with a counter inside it is not deterministic, so neither
    filters nor projections above copy its expressions."""
    return F.struct(F.monotonically_increasing_id().alias("once"), *(F.expr(e).alias(n) for n, e in fields.items()))


def measures(docs: DataFrame) -> DataFrame:
    """docs and q_words, q_chars, q_symbols, q_lines, q_dup_lines, q_repeats (long). Null text: empty.

    q_repeats counts the words in 8-word windows found twice or more in their text: only texts with such a window sort
    their window hashes; the words covered are the sum of the steps between the windows' places, 8 at most each.
    """
    d = docs.withColumn("q1", _once(text="coalesce(text, '')", list=f"array_remove(split(coalesce(text, ''), '[{_WHITE}]+'), '')", line=f"filter(split(coalesce(text, ''), '\\n'), x -> x RLIKE '[^{_WHITE}]')"))
    d = d.withColumn("q2", _once(
        words="size(q1.list)", chars="length(array_join(q1.list, ''))", symbols="regexp_count(q1.text, '[#*$%&|<>]')", lines="size(q1.line)", dup="size(q1.line) - size(array_distinct(q1.line))",
        hash="if(size(q1.list) < 9, array(), transform(sequence(1, size(q1.list) - 7), i -> xxhash64(slice(q1.list, i, 8))))",
    ))
    d = d.withColumn("q3", _once(repeats=f"if(size(array_distinct(q2.hash)) = size(q2.hash), 0, {_REPEATS})", words="q2.words", chars="q2.chars", symbols="q2.symbols", lines="q2.lines", dup="q2.dup"))
    named = {"q_words": "words", "q_chars": "chars", "q_symbols": "symbols", "q_lines": "lines", "q_dup_lines": "dup", "q_repeats": "repeats"}
    return d.select(*docs.columns, *(F.col(f"q3.{v}").cast("long").alias(k) for k, v in named.items()))


def _base(m: DataFrame) -> DataFrame:
    share = lambda a, b: F.expr(f"if({b} = 0, 0, {a} * {ONE} div {b})")
    return m.withColumns({
        "q_base": F.expr("q_words < 20 OR 100 * q_repeats > 30 * q_words"),
        "q_sym": share("q_symbols", "q_words"), "q_dup": share("q_dup_lines", "q_lines"), "q_len": share("q_chars", "q_words"),
    })


def fences(m: DataFrame) -> DataFrame:
    """Thresholds of each (lang, source) from measures: sym_most, dup_most, len_least, len_most, in millionths.

    A quantile sketch counts values by bins whose width is 1/32 of the value's power of two: sketches merge by adding
    counts, so groups of any size are reduced before the shuffle, and a quantile is off by 1/32 at most. A fence stands
    three quartile distances beyond the quartile, within fixed bounds. Rows that fail the base rules don't count.
    """
    rows = m.where("NOT q_base").select("lang", "source", F.expr("stack(3, 'sym', q_sym, 'dup', q_dup, 'len', q_len) as (measure, v)"))
    rows = rows.withColumn("e", F.expr("greatest(length(bin(v)) - 6, 0)")).withColumn("low", F.expr("shiftleft(shiftright(v, e), e)"))
    sketch = rows.groupBy("lang", "source", "measure", "low").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "measure")
    sketch = sketch.select("*", F.sum("n").over(group.orderBy("low")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda name, per: F.min(F.when((F.col("measure") == name) & (100 * F.col("upto") >= per * F.col("total")), F.col("low")))
    q = sketch.groupBy("lang", "source").agg(*(at(n, p).alias(f"{n}{p}") for n in ("sym", "dup", "len") for p in (25, 50, 75)))
    most = lambda n: F.expr(f"least(greatest({n}75 + 3 * ({n}75 - {n}25), {FLOOR[n]}), {CEILING[n]})").alias(f"{n}_most")
    return q.select(
        "lang", "source", most("sym"), most("dup"),
        F.expr("least(len25 - 3 * (len75 - len25), len50 * 6 div 10)").alias("len_least"),
        F.expr("greatest(len75 + 3 * (len75 - len25), len50 * 16 div 10)").alias("len_most"),
    )


def _joined(m: DataFrame, f: DataFrame) -> DataFrame:
    f = f.withColumnsRenamed({"lang": "q_lang_f", "source": "q_source_f"})
    on = m["lang"].eqNullSafe(f["q_lang_f"]) & m["source"].eqNullSafe(f["q_source_f"])
    good = "NOT q_base AND q_sym <= sym_most AND q_dup <= dup_most AND q_len BETWEEN len_least AND len_most"
    return m.join(f, on, "left").withColumn("q_kept", F.coalesce(F.expr(good), F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    docs: doc_id, text, lang, source; other columns are not read. Null text: no words, so base_failed. Null lang or
    source: a group like others. Rows that repeat are judged each. A group whose rows all fail the base rules has no
    thresholds and keeps none. An empty table gives no rows.
    """
    m = _io.stored(_base(measures(docs.select("doc_id", "text", "lang", "source"))).drop("text"), "measures")
    return _joined(m, fences(m)).select("doc_id", F.col("q_words").alias("n_words"), F.col("q_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"), F.col("q_repeats").alias("n_repeat_words"), F.col("q_base").alias("base_failed"), F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their columns, whatever their names. Measures are taken twice
    rather than written with the texts, which takes less memory and disk but more time; the fences, a row for each language
    and source, go to the rows as long as there are few of them, so that texts stay where they are."""
    f = _io.stored(fences(_base(measures(docs.select("text", "lang", "source")))), "fences")
    if f.count() <= FEW:
        f = F.broadcast(f)
    m = _base(measures(docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source")))
    return _joined(m, f).where("q_kept").select("row.*")


def op9_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    return judge(_io.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS row_no
  FROM documents),
win AS (
  SELECT row_no, i, list_slice(w, i, i + 7) AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (
  SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS nxt
  FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT row_no, sum(least(8, coalesce(nxt - i, 8))) AS r FROM dup GROUP BY row_no),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (row_no)),
b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         CASE WHEN n_words = 0 THEN 0 ELSE n_symbols * 1000000 // n_words END AS sym,
         CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000000 // n_lines END AS dup,
         CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 1000000 // n_words END AS len FROM m),
v AS (
  SELECT lang, source, 'sym' AS k, sym AS v FROM b WHERE NOT base_failed UNION ALL
  SELECT lang, source, 'dup', dup FROM b WHERE NOT base_failed UNION ALL
  SELECT lang, source, 'len', len FROM b WHERE NOT base_failed),
low AS (
  SELECT lang, source, k, (v >> e) << e AS low, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0)::BIGINT AS e FROM v) GROUP BY ALL),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, k ORDER BY low) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM low),
q AS (
  SELECT lang, source,
         min(low) FILTER (k = 'sym' AND 100 * upto >= 25 * total) AS sym25, min(low) FILTER (k = 'sym' AND 100 * upto >= 75 * total) AS sym75,
         min(low) FILTER (k = 'dup' AND 100 * upto >= 25 * total) AS dup25, min(low) FILTER (k = 'dup' AND 100 * upto >= 75 * total) AS dup75,
         min(low) FILTER (k = 'len' AND 100 * upto >= 25 * total) AS len25, min(low) FILTER (k = 'len' AND 100 * upto >= 50 * total) AS len50,
         min(low) FILTER (k = 'len' AND 100 * upto >= 75 * total) AS len75
  FROM c GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND sym <= least(greatest(sym75 + 3 * (sym75 - sym25), 100000), 300000)
         AND dup <= least(greatest(dup75 + 3 * (dup75 - dup25), 500000), 700000)
         AND len >= least(len25 - 3 * (len75 - len25), len50 * 6 // 10)
         AND len <= greatest(len75 + 3 * (len75 - len25), len50 * 16 // 10), false) AS kept
FROM b LEFT JOIN q ON b.lang IS NOT DISTINCT FROM q.lang AND b.source IS NOT DISTINCT FROM q.source
"""
