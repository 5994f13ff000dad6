"""Benchmark decontamination by winnowing, from DataFrame expressions only.

Of the hashes of all 5-grams of words, the least in each window of 6 is a fingerprint. Whenever 10 words in a
row are shared, so are those 6 hashes and therefore their least: no such span can be missed. Documents whose
fingerprints meet a benchmark's are read again, each hit is extended to the windows of 10 words around it, and
those are compared word by word. Items of fewer than 10 words are one window, fingerprinted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import free_names, let
from tidewell.tables import materialize, table

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the benchmark side up to which it is broadcast, after they have been counted; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Keys and fingerprints of suspect documents up to which they are broadcast.
BROADCAST_NUMBERS = 2_000_000


def words(text: str) -> Column:
    """Words of a text with small A to Z; null has none."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


_NONE = "array<bigint>"


def _grams(w: Column, n: int) -> Column:
    """Hashes, never 0, of all n-grams of the array of words ``w``."""
    hashed = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n)))
    never0 = lambda h: F.when(h == 0, F.lit(1).cast("long")).otherwise(h)
    return F.when(F.size(w) >= n, F.transform(F.transform(F.sequence(F.lit(0), F.size(w) - n), hashed), never0)).otherwise(F.array().cast(_NONE))


def _winnowed(w: Column, h: Column) -> Column:
    """The distinct least hashes of all windows; ``h``: hashes of all 5-grams."""
    least = F.transform(F.sequence(F.lit(1), F.size(w) - SPAN + 1), lambda i: F.array_min(F.slice(h, i, F.lit(WINDOW))))
    return F.when(F.size(w) >= SPAN, F.array_distinct(least)).otherwise(F.array().cast(_NONE))


def _fingerprints(w: Column, shorts: list[int]) -> Column:
    """The fingerprints of an array of words, with all n-grams of the lengths of short items."""
    return F.concat(let(_grams(w, GRAM), lambda h: _winnowed(w, h)), *(F.array_distinct(_grams(w, n)) for n in shorts))


def _keys(text: str, id_col: str) -> tuple[Column, Column]:
    """128 bits that name a row by its id and text, null or not; equal rows have equal keys."""
    return F.xxhash64(F.col(id_col), F.col(text), F.col(id_col).isNull()), F.xxhash64(F.lit(7), F.col(text), F.col(id_col), F.col(text).isNull())


def _small(df: DataFrame, numbers: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has proved small: in rows, and in ``numbers``, the sizes of its arrays."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    if numbers is not None and (df.agg(F.sum(numbers)).first()[0] or 0) > BROADCAST_NUMBERS:
        return df
    return F.broadcast(df)


class Benchmark:
    """What documents are held against: fingerprints, windows, and the items that hold each window."""

    def __init__(self, items: DataFrame, text: str, item_id: str):
        own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
        own = materialize(own.withColumn("len", F.least(F.size("w"), F.lit(SPAN))))
        self.shorts = sorted(r[0] for r in own.where(F.col("len") < SPAN).select("len").distinct().collect())
        fps = own.where(F.size("w") >= SPAN).select(F.explode(_fingerprints(F.col("w"), [])).alias("fp"))
        for n in self.shorts:
            fps = fps.unionByName(own.where(F.size("w") == n).select(F.explode(_grams(F.col("w"), n)).alias("fp")))
        self.fingerprints = materialize(fps.distinct())
        spans = own.select("item", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"), "w")
        spans = spans.select("item", "len", F.array_join(F.slice("w", F.col("s"), F.col("len")), " ").alias("span"))
        held = spans.groupBy("len", "span").agg(F.sort_array(F.collect_set("item")).alias("items"))
        self.windows = materialize(held.withColumn("sid", F.md5(F.concat_ws("\u001f", "items").cast("binary"))))
        self.item_sets = materialize(self.windows.select("sid", "items").dropDuplicates(["sid", "items"]))


def find_hits(docs: DataFrame, text: str, id_col: str, bench: Benchmark) -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: id, r1, r2, n_words, one for each document; r1 and r2 are ``_keys`` of it. hits, one for each key that has any: r1, r2, spans, sids.

    ``spans``: sorted [start, length] in words of all windows found. Documents are read once for words and
    fingerprints; only those that share one are read again.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for c, n in zip(_keys(text, id_col), ("r1", "r2"))), F.col(text).alias("_text"))
    # Each document's own row goes along under its key, which spreads evenly, whether or not the join is shuffled.
    nothing = F.lit(None).cast("long")
    own = lambda w: F.concat(
        F.array(F.struct(F.col("r1").alias("fp"), F.size(w).cast("long").alias("n_words"))),
        F.transform(_fingerprints(w, bench.shorts), lambda f: F.struct(f.alias("fp"), nothing.alias("n_words"))),
    )
    shared = keyed.select("_id", "r1", "r2", F.explode(let(words("_text"), own)).alias("x")).select("_id", "r1", "r2", "x.fp", "x.n_words")
    met = shared.join(_small(bench.fingerprints.withColumn("met", F.lit(True))), "fp", "left")
    seen = materialize(met.where("met OR n_words IS NOT NULL"))
    rows = seen.where("n_words IS NOT NULL").select(F.col("_id").alias(id_col), "r1", "r2", "n_words")
    suspects = materialize(seen.where("n_words IS NULL").groupBy("r1", "r2").agg(F.collect_set("fp").alias("fps")))
    few = (suspects.agg(F.sum(F.size("fps") + 2)).first()[0] or 0) <= BROADCAST_NUMBERS
    again = keyed.select("r1", "r2", "_text").join(F.broadcast(suspects) if few else suspects, ["r1", "r2"])

    def span(w: Column, n: int):
        return lambda s: F.struct(s.cast("int").alias("s"), F.lit(n).alias("len"), F.array_join(F.slice(w, s + 1, F.lit(n)), " ").alias("span"))

    def near(w: Column, h: Column) -> Column:
        """Starts of the windows that hold a 5-gram whose hash is a shared fingerprint."""
        met = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(F.col("fps"), F.get(h, i)))
        return F.array_distinct(F.flatten(F.transform(met, lambda i: F.sequence(F.greatest(F.lit(0), i - (SPAN - GRAM)), F.least(i, F.size(w) - SPAN)))))

    def windows(w: Column) -> Column:
        kind = "array<struct<s:int,len:int,span:string>>"
        found = F.when(F.size(w) >= SPAN, let(_grams(w, GRAM), lambda h: F.transform(near(w, h), span(w, SPAN)))).otherwise(F.array().cast(kind))
        for n in bench.shorts:
            found = F.concat(found, F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), span(w, n))).otherwise(F.array().cast(kind)))
        return found

    spans = again.select("r1", "r2", F.explode(let(words("_text"), windows)).alias("x")).select("r1", "r2", "x.*")
    hits = spans.join(_small(bench.windows.select("len", "span", "sid"), F.length("span") / 8), ["len", "span"])
    hits = hits.groupBy("r1", "r2").agg(F.sort_array(F.collect_set(F.struct("s", "len"))).alias("spans"), F.collect_set("sid").alias("sids"))
    return rows, materialize(hits)


def covered(spans: str) -> Column:
    """How many words lie inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, x: Column) -> Column:
        end = (x["s"] + x["len"]).cast("long")
        return F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(a["end"], x["s"].cast("long")))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.col(spans), start, add, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs.

    All columns stay; repeated rows stay or go alike; null and wordless texts stay; an empty benchmark takes nothing away.
    """
    _, hits = find_hits(docs, text, id_col, Benchmark(items, item_text, item_id))
    k1, k2, r1, r2 = free_names(docs, "__k1", "__k2", "__r1", "__r2")
    keyed = docs.withColumns(dict(zip((k1, k2), _keys(text, id_col))))
    return keyed.join(_small(hits.select(F.col("r1").alias(r1), F.col("r2").alias(r2))), (F.col(k1) == F.col(r1)) & (F.col(k2) == F.col(r2)), "left_anti").drop(k1, k2)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items whose windows occur in it.

    Null and wordless texts have no words and no hits; a null item_id counts as the empty string; documents
    that repeat are reported each; an empty benchmark hits nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = Benchmark(table(spark, sf_dir, "benchmark"), "text", "item_id")
    rows, hits = find_hits(docs, "text", "doc_id", bench)
    named = hits.select("r1", "r2", F.explode("sids").alias("sid")).join(_small(bench.item_sets, F.size("items")), "sid").select("r1", "r2", F.explode("items").alias("item"))
    named = named.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = hits.select("r1", "r2", covered("spans").alias("n_hit")).join(named, ["r1", "r2"])
    out = rows.join(_small(materialize(result)), ["r1", "r2"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT * FROM (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item, n, array_to_string(w[s:s + n - 1], ' ') AS span FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b)),
k AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS span FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, k WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.n, dw.s, bw.item FROM dw JOIN bw USING (n, span)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, n, s FROM h)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
