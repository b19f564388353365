"""Secret scans, native: rules for known forms, and character Markov models for random strings.

Base rules find assignments, access keys and hexadecimal runs. Besides, every run of `CANDIDATE` or more token
characters is scored by two first-order Markov models of characters, one of random strings and one of ordinary
identifiers: the log-likelihood ratio of its character pairs. Runs above `MARGIN` nats in total and `MEAN` a pair are
secrets too, unless they overlap a base span.

The models are fitted on labelled samples: (text, random). `corpus_samples` labels a bounded number of documents, at
most about `SAMPLE_DOCUMENTS`, chosen by a hash of the key: values that base rules find and generated digests are
random; ordinary words, alone and joined to identifiers, are not. Only counts of character pairs reach the driver.

Everything is DataFrame expressions; a match's place follows from the lengths of the pieces between the matches.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; repeated rows and any
doc_id are scanned row by row; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# The forms of the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so their least length can be asked for at once
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

SAMPLE_DOCUMENTS, MARGIN, MEAN = 1000, 12.0, 0.6
#: Matches of a text that are worked on at once.
LOT = 128
#: Characters of the models: code 43 (+) to 122 (z).
_LOW, _WIDE = 43, 80
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lots(items: Column) -> Column:
    """An array, not empty, in slices of LOT: work within slices keeps long arrays from costing their square."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / LOT).cast("int")), lambda i: F.slice(x, i * LOT + 1, F.lit(LOT))))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers, what those before it come to, from 0."""
    step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]


def _places(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """Spans of the matches: each starts after all pieces and matches before it."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    steps = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["hit"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["hit"]).alias("end")))).alias("out"),
    )
    total = lambda lot: F.aggregate(lot, F.lit(0), lambda a, x: a + x["gap"] + x["hit"])
    walk = lambda lots, at: F.flatten(F.transform(lots, lambda lot, i: F.aggregate(lot, F.struct(F.get(at, i).alias("at"), _empty().alias("out")), step)["out"]))
    spans = _let(_lots(steps), lambda lots: _let(_running(F.transform(lots, total), lambda a, x: a + x), lambda at: walk(lots, at)))
    return F.when(F.size(hits) > 0, spans).otherwise(_empty())


def _passing(spans: Column, hits: Column, ok) -> Column:
    """The spans whose match passes; both arrays run alike."""
    both = F.filter(F.arrays_zip(spans.alias("span"), hits.alias("hit")), lambda x: ok(x["hit"]))
    return F.transform(both, lambda x: x["span"])


def with_base(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with _assign, _access and _hex, arrays of spans, and _values, the matched strings."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns(
        {
            "_a": F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)),
            "_k": F.when(F.contains(body, F.lit("AKIA")), F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")),
            "_h": F.regexp_extract_all(body, F.lit(HEX), F.lit(0)),
        }
    )
    value = lambda x: F.regexp_extract(x, ASSIGN, 2)
    rows = rows.withColumns({"_assign": _places(body, F.col("_a"), ASSIGN, 0), "_access": _places(body, F.col("_k"), ACCESS, 1), "_hex": _places(body, F.col("_h"), HEX, 2)})
    return rows.withColumns(
        {
            "_assign": _passing(F.col("_assign"), F.col("_a"), lambda x: F.length(value(x)) >= 6),
            "_access": _passing(F.col("_access"), F.col("_k"), lambda x: F.length(x) >= 20),
            "_values": F.concat(F.transform("_a", value), "_k", "_h"),
        }
    ).drop("_a", "_k", "_h")


# --- the models -------------------------------------------------------------

def _pairs(text: Column) -> Column:
    """Codes of neighbouring characters, _WIDE * first + second."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")
    code = F.transform(chars, lambda c: F.ascii(c) - _LOW)
    n = F.size(code)
    return F.zip_with(F.slice(code, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(code, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a * _WIDE + b)


def fit(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair, random against ordinary. samples: (text, random boolean)."""
    found = (
        samples.select("random", F.explode(_pairs(F.col("text"))).alias("pair"))
        .where((F.col("pair") >= 0) & (F.col("pair") < _WIDE * _WIDE))
        .groupBy("random", "pair")
        .count()
        .collect()  # at most two counts a pair of characters
    )
    counts = {True: [smooth] * (_WIDE * _WIDE), False: [smooth] * (_WIDE * _WIDE)}
    for r in found:
        counts[r["random"]][r["pair"]] += r["count"]
    table = [0.0] * (_WIDE * _WIDE)
    for a in range(_WIDE):
        row = slice(a * _WIDE, (a + 1) * _WIDE)
        one, other = sum(counts[True][row]), sum(counts[False][row])
        for i in range(row.start, row.stop):
            table[i] = round(math.log(counts[True][i] / one) - math.log(counts[False][i] / other), 4)
    return table


def score(text: Column, table: list[float]) -> Column:
    """Sum of the ratios over the pairs of a string of token characters."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to one constant
    return F.aggregate(_pairs(text), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.get(ratios, p), F.lit(0.0)))


def is_random(text: Column, table: list[float]) -> Column:
    s = score(text, table)
    return (s >= MARGIN) & (s >= MEAN * (F.length(text) - 1))


def corpus_samples(documents: DataFrame, size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(text, random) from at most about `size` documents and as many generated digests."""
    spark = documents.sparkSession
    n = documents.count()
    part = documents.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(max(1, math.ceil(n / size)))) == 0).select("text").distinct()
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few rows, much work: else one task has them all
    found = with_base(part).select(
        "text", F.filter("_values", lambda v: (F.length(v) >= 16) & v.rlike("[0-9]")).alias("secrets"), F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{2,40}\b"), F.lit(0)).alias("words")
    )
    word = F.filter("words", lambda w: F.length(w) >= 2)
    n_words = F.size("w")
    triple = F.transform(F.sequence(F.lit(1), F.greatest(n_words - 2, F.lit(1)), F.lit(3)), lambda i: F.array(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))
    ordinary = found.select(word.alias("w")).where(n_words >= 3).select(F.col("w"), F.explode(triple).alias("t"))
    names = ordinary.select(
        F.explode(
            F.array(
                F.array_join("t", "_"), F.array_join("t", "-"), F.array_join("t", "/"), F.array_join("t", ""),
                F.array_join(F.transform("t", F.initcap), ""), F.upper(F.array_join("t", "_")), F.concat(F.array_join("t", "_"), F.lit("_2")), F.concat(F.array_join("t", "-"), F.lit("=1")),
            )
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    text64 = F.base64(digest)
    made = spark.range(size).select(F.explode(F.array(text64, F.regexp_replace(text64, "[+/=]", ""), F.upper(F.regexp_replace(text64, "[+/=]", "")), F.translate(text64, "+/=", "-_"), F.sha2(F.col("id").cast("string"), 224))).alias("text"), F.lit(True).alias("random"))
    secrets = found.select(F.explode("secrets").alias("text"), F.lit(True).alias("random"))
    return names.unionByName(made).unionByName(secrets)


def scan(rows: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """rows with _assign, _access, _hex, _base and _spans: arrays of (start, kind, end), sorted."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = with_base(rows, text).drop("_values").withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    rows = rows.withColumn("_c", F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("_m", _places(body, F.col("_c"), CANDIDATE, 3))
    more = _passing(F.col("_m"), F.col("_c"), lambda x: is_random(x, table))
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    around = lambda lot: F.struct(lot[0]["start"].alias("start"), F.element_at(lot, -1)["end"].alias("end"))
    clear = lambda lot: _let(F.filter("_base", lambda b: meet(b, around(lot))), lambda near: F.filter(lot, lambda m: ~F.exists(near, lambda b: meet(b, m))))
    apart = _let(more, lambda m: F.when(F.size(m) > 0, F.flatten(F.transform(_lots(m), clear))).otherwise(_empty()))
    return rows.withColumn("_m", F.when(F.size("_c") > 0, apart).otherwise(_empty())).withColumn("_spans", F.array_sort(F.concat("_base", "_m"))).drop("_c", "_m")


def spelled(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """text with each union of spans replaced by mark."""
    body = F.coalesce(F.col(text), F.lit(""))
    most = lambda lot: F.array_max(F.transform(lot, lambda x: x["end"]))

    def walk(lot: Column, at: Column) -> Column:
        """The text from at on to the lot's last end."""

        def pieces(part: Column) -> Column:
            step = lambda acc, x: F.struct(
                F.greatest(acc["at"], x["end"]).alias("at"),
                F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(part, acc["at"] - at + 1, x["start"] - acc["at"]), F.lit(mark)))).alias("out"),
            )
            return F.array_join(F.aggregate(lot, F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step)["out"], "")

        return _let(F.substring(body, at + 1, F.greatest(most(lot), at) - at), pieces)

    joined = lambda lots, at: F.array_join(F.transform(lots, lambda lot, i: _let(F.get(at, i), lambda a: walk(lot, a))), "")
    front = _let(_lots(F.col(spans)), lambda lots: _let(_running(F.transform(lots, most), lambda a, x: F.greatest(a, x)), lambda at: joined(lots, at)))
    return F.when(F.size(spans) > 0, F.concat(front, F.substring(body, most(F.col(spans)) + 1, F.length(body)))).otherwise(F.col(text))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    table = fit(corpus_samples(docs))
    return scan(docs, table).select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(spelled("_base"), 256).alias("base_sha256"),
        spelled("_spans").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mark; n_chars follows the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # out of the way of all other names
    out = scan(docs.select("text", row), fit(corpus_samples(docs.select("doc_id", "text")))).withColumn("clean", redacted("text", "_spans"))
    new = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.size("_spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(new.alias("row")).select("row.*")
