"""Order MinHash fingerprints with DataFrame functions only.

A text is a row of tokens (runs of at most TOKEN code points without white space); its k-mers are K consecutive
tokens, and the i-th occurrence of a k-mer is an element of its own. There are ORDERS hash orders of all elements:
an element's rank under order b is its hash with the leading bits changed by a permutation of its own (`_leads`), so any element may come first under any
order, and the few elements of a short text, which seldom share their leading bits, stand in unrelated orders.
Under each order the PICK smallest elements are selected, put back into text order, and their k-mers hashed as a tuple; signatures are
therefore sensitive to order as well as content. Likeness is the share of orders with equal signatures.

Each order has another class of leading bits first. All orders agree on elements whose leading bits are equal, so the PICK smallest of each of the ORDERS classes of leading bits are all that any order can
select; where every class has PICK elements, an order selects those of its first class. They are read off one sorted array of longs that hold a hash of 33 bits above a position of 31, more than a value of Spark has code points. First
occurrences carry the k-mer's own hash; the others, runs of equal hashes in sorted order, that hash mixed with their occurrence number.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN, K, ORDERS, PICK = 3, 2, 32, 2
_PLACE = (1 << 31) - 1
_LEAD = 64 - (ORDERS.bit_length() - 1)


def _least(a: str) -> str:
    """The PICK first elements of each class of leading bits in a sorted array: those whose class the element PICK places before them doesn't share."""
    return f"filter({a}, (x, i) -> i < {PICK} OR shiftright(x ^ get({a}, i - {PICK}), {_LEAD}) <> 0)"


def _leads() -> list[int]:
    """For each order and each value of the leading bits the value that replaces them: 0 where both are equal, the others by a checksum of the two."""
    out = []
    for b in range(ORDERS):
        rank = sorted(range(ORDERS), key=lambda c: (c != b, zlib.crc32(f"{b},{c}".encode()), c))  # noqa: B023
        out += [rank.index(c) for c in range(ORDERS)]
    return out


def _firsts() -> list[int]:
    """For each order the place of its first class among all classes, as they stand in a sorted array: longs are signed, so the upper half comes first."""
    leads, half = _leads(), ORDERS // 2
    return [min(range(ORDERS), key=lambda c: leads[b * ORDERS + c] ^ half) ^ half for b in range(ORDERS)]  # noqa: B023


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: array<long> of ORDERS signatures, all null for a text without tokens; a text of fewer than K tokens is one k-mer."""
    gram = lambda at: ", ".join(f"get(_t, {at} + {j})" for j in range(K))
    df = df.withColumn("_t", F.regexp_extract_all(F.col(text), F.lit(f"[^\\x20\\x09-\\x0D]{{1,{TOKEN}}}"), F.lit(0)))
    df = df.withColumn("_s", F.expr(f"CASE WHEN size(_t) > 0 THEN sort_array(transform(sequence(0, greatest(size(_t) - {K}, 0)), i -> (xxhash64({gram('i')}) & {~_PLACE}L) | i)) ELSE array() END"))
    # occurrences of a k-mer after its first one, then the first ones
    df = df.withColumn("_d", F.expr("filter(_s, (x, i) -> i > 0 AND shiftright(x ^ get(_s, i - 1), 31) = 0)"))
    df = df.withColumn("_f", F.expr("CASE WHEN size(_d) > 0 THEN array_except(_s, _d) ELSE _s END"))
    run = "j = 0 OR shiftright(get(_d, j) ^ get(_d, j - 1), 31) <> 0"
    df = df.withColumn("_r", F.expr(f"CASE WHEN size(_d) > 0 THEN filter(sequence(0, size(_d) - 1), j -> {run}) ELSE array() END"))
    df = df.withColumn("_e", F.expr(f"""sort_array(flatten(transform(_r, (s, q) -> transform(slice(_d, s + 1, coalesce(get(_r, q + 1), size(_d)) - s),
        (x, o) -> (xxhash64(shiftright(x, 31), o) & {~_PLACE}L) | (x & {_PLACE}L)))))"""))
    df = df.withColumn("_m", F.expr(f"sort_array(concat({_least('_f')}, {_least('_e')}))"))
    df = df.withColumn("_m", F.expr(_least("_m")))
    df = df.withColumn("_l", _numbers(_leads())).withColumn("_o", _numbers(_firsts()))
    moved = f"(x & {(1 << _LEAD) - 1}L) | shiftleft(get(_l, CAST(b * {ORDERS} + shiftrightunsigned(x, {_LEAD}) AS INT)), {_LEAD})"
    pick = f"array_sort(transform(slice(sort_array(transform(_m, x -> {moved})), 1, {PICK}), x -> CAST(x & {_PLACE}L AS INT)))"
    full = f"sort_array(transform(slice(_m, CAST({PICK} * get(_o, CAST(b AS INT)) + 1 AS INT), {PICK}), x -> CAST(x & {_PLACE}L AS INT)))"
    df = df.withColumn("_p", F.expr(f"transform(sequence(0L, {ORDERS - 1}L), b -> CASE WHEN size(_m) = {ORDERS * PICK} THEN {full} WHEN size(_m) > 0 THEN {pick} ELSE array() END)"))
    grams = ", ".join(gram(f"get(p, {j})") for j in range(PICK))
    df = df.withColumn(out, F.expr(f"transform(_p, p -> CASE WHEN size(p) > 0 THEN xxhash64({grams}) END)"))
    return df.drop("_t", "_s", "_d", "_f", "_r", "_e", "_m", "_l", "_o", "_p")


def shown(signature: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits an order, dashes for a text without tokens."""
    return F.expr(f"array_join(transform({signature}, x -> coalesce(lpad(hex(x & 4294967295L), 8, '0'), '--------')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of orders with equal signatures (their 32 bits that are shown); 1 if neither text has tokens."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> (x & 4294967295L) <=> (y & 4294967295L)), z -> z))"
    return F.expr(f"CAST({same} AS DOUBLE) / {ORDERS}")


def _numbers(values: list[int]) -> Column:
    """A constant array of longs, one literal in the plan whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row with the next greater doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id, a few per shuffle partition, whose bounds are percentiles; the first row of each range is also
    sent to the range before it, so that no window spans more than a range. Only the bounds and first ids of the ranges reach the driver, and
    go to the tasks as arrays that are looked up by a range's number.
    """
    spark = df.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx("doc_id", at, 10 * ranges).alias("b")).first()["b"] or []))
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col("doc_id")))
    df = df.withColumn("_c", below(_numbers(bounds[step - 1 :: step])))
    df = df.withColumn("_b", F.col("_c") * step + below(F.slice(_numbers(bounds), F.col("_c") * step + 1, F.lit(step)))).drop("_c")
    found = sorted((r["_b"], r["f"]) for r in df.select("doc_id", "_b").groupBy("_b").agg(F.min("doc_id").alias("f")).collect())
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (b, f) in enumerate(found):
        first[b], before[b] = f, found[i - 1][0]
    own, late = F.struct(F.col("_b").cast("long").alias("b"), F.lit(0).alias("late")), F.struct(F.get(_numbers(before), F.col("_b")).alias("b"), F.lit(1).alias("late"))
    df = df.withColumn("_to", F.explode(F.when(F.get(_numbers(first), F.col("_b")) == F.col("doc_id"), F.array(own, late)).otherwise(F.array(own)))).select("*", "_to.*").drop("_to", "_b")
    w = Window.partitionBy("b").orderBy("late", "doc_id", F.xxhash64("text"))
    return df.select("*", *[F.lead(x).over(w).alias(f"next_{x}") for x in columns]).filter("late = 0").drop("b", "late")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    A null text counts as empty. The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by doc_id; after the last comes the first, and a lone document follows
    itself. Rows that share a doc_id follow each other in order of their text's hash; of the rows of the next doc_id the first in that order counts.
    Rows with a null doc_id are left out.
    """
    df = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = _with_next(with_signature(df, "text", "sig"), ["text", "sig"])
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("CAST(n_chars DIV 2 AS INT)"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - half), substring(next_text, 1, half))")).drop("text", "next_text")
    df = with_signature(df, "edited", "esig")
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("sig").alias("fingerprint"), shown("esig").alias("edited_fingerprint"), likeness("sig", "esig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"))
