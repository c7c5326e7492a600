"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM code points has a hash, every run of WINDOW hashes gives its least one, of equal ones the rightmost; the chosen
(position, hash) entries are the fingerprint. So any two texts that share GRAM + WINDOW - 1 code points in a row share an entry,
and no match under GRAM code points is reported. The hash is the CRC-32 of the run's UTF-32 bytes, a Rabin fingerprint: a remainder
of polynomials, for which the rolling rule h(i + 1) = h(i) less the code point that leaves, shifted, plus the one that enters, holds
(the tests roll it). Here each run is sliced from a fixed-width copy of the text instead, as columns have no running fold that is
linear, and reading one code point out of a text costs a column as much as the checksum of the whole run.

Texts are cut into blocks of BLOCK windows, so arrays stay small however long a text is. A window is looked through only where its
least hash may change: the hash that enters or the one that leaves has to be no more than the least of the half window that both
windows hold for certain, which holds for some six in a hundred. Entries are one number, position << 32 | hash; the string form
is these in upper-case hex, in order of position, comma-joined: the last eight digits are the hash, those before it the position.

Edge cases: null and empty texts have no entry; a text under GRAM code points counts as one run, filled up with zero code points; one
with fewer than WINDOW runs is one window; equal texts have equal fingerprints; a very long text is one row of blocks; the likeness of
two fingerprints without entries is 1, of which only one has none 0; extra columns are left out; an empty table gives none.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import positions
from .common import materialise, table

GRAM, WINDOW = 24, 64
#: Windows of a block.
BLOCK = 1000


def once(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """What is made of a value, with the value worked out and copied once, not for each element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprints(docs: DataFrame, key: str = "key", text: str = "text", gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, text) to (key, entries), a row a key: the sorted entries of its text; rows that share a key have to share the text."""
    n = F.greatest(F.length("text"), F.lit(gram))
    last = F.greatest(n - gram - window + 1, F.lit(0)) / F.lit(block)

    def cut(wide: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(last).cast("int")), lambda q: F.substring(wide, q * (4 * block) + 1, F.lit(4 * (block + window + gram - 2))))

    wide = F.rpad(F.encode("text", "UTF-32"), F.lit(4) * n, F.lit(bytearray(1)))
    blocks = F.when(F.length("text") > 0, once(wide, cut))
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", F.posexplode_outer(blocks).alias("block", "part"))
    runs = F.floor(F.length("part") / F.lit(4)).cast("int") - gram + 1
    half = max(1, window // 2)
    end = 4 * runs - 3
    crc = lambda part, i: F.crc32(F.substring(part, i, F.lit(4 * gram)))
    stretch = lambda part, s: F.transform(F.sequence(s, F.least(s + 4 * (half - 1), end), F.lit(4)), lambda i: crc(part, i))
    d = d.select("key", "block", once("part", lambda part: F.transform(F.sequence(F.lit(1), end, F.lit(4 * half)), lambda s: stretch(part, s))).alias("stretches"))
    d = d.select("key", "block", F.flatten("stretches").alias("values"), F.transform("stretches", F.array_min).alias("halves"))
    d = d.select("key", "block", "values", "halves", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("values") - window, F.lit(0)))).alias("at"))
    moved = F.least(F.col("values")[F.col("at") + window - 1], F.col("values")[F.col("at") - 1])
    inside = F.col("halves")[F.floor((F.col("at") + half - 2) / F.lit(half)).cast("int")]  # the first half that starts in the window before
    least = lambda start: F.array_min(F.slice("values", start, F.lit(window)))
    changed = F.when(F.col("at") == 0, True).otherwise((moved <= inside) & (moved <= least(F.col("at"))))
    d = d.where(F.col("at").isNull() | changed).select("key", "block", "at", F.slice("values", F.col("at") + 1, F.lit(window)).alias("seen"))
    d = d.select("key", "block", "at", "seen", F.array_min("seen").alias("least"))
    place = F.col("block").cast("bigint") * block + F.col("at") + F.size("seen") - F.array_position(F.reverse("seen"), F.col("least"))
    d = d.select("key", F.shiftleft(place, 32).bitwiseOR(F.col("least")).alias("entry"))
    return d.groupBy("key").agg(F.array_sort(F.array_distinct(F.collect_list("entry"))).alias("entries"))


def hashes(entries: str) -> Column:
    """The distinct hashes of entries, as signed numbers of four bytes."""
    return F.array_distinct(F.transform(entries, lambda e: (e.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes over all, 1 where there are none at all."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def shown(entries: str) -> Column:
    return F.array_join(F.transform(entries, F.hex), ",")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, times) of distinct keys, with before and n_before: the document before in descending doc_id, round the end.

    Rows that share a doc_id stand in the order of their texts' digests, those without one at the end.
    """
    placed = materialise(positions(docs, [F.col("doc_id").desc_nulls_last(), F.col("key")], "place"))
    ends = placed.agg(F.max("place").alias("many"))
    d = placed.crossJoin(F.broadcast(ends))  # one row
    d = d.select("doc_id", "key", "n", "times", F.when(F.col("place") == 1, F.col("many")).otherwise(F.col("place") - 1).alias("place"))
    return materialise(d.join(placed.select("place", F.col("key").alias("before"), F.col("n").alias("n_before")), "place").drop("place"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Fingerprints of each text and of it with its last third replaced by the start of the next document's, and their likeness.

    The next document is the one with the next smaller doc_id, after the last the first. Rows that are equal in doc_id and text are
    one document, returned as often as it comes. Texts travel once, to meet the start of the next; entries travel once for the own
    side and once for the next. Of the edited text only the end, from where windows first see the change, is winnowed anew.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), whole.alias("text"))
    d = d.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5("text")))
    order = neighbours(d.groupBy("doc_id", "key", F.length("text").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("times")))
    own = fingerprints(d, gram=gram, window=window, block=block)
    texts = d.groupBy("key").agg(F.first("text").alias("text"))  # the same columns for both uses, so that they share one exchange
    placed = texts.join(order.drop("before", "n_before"), "key")
    starts = texts.join(order, "key").select(F.col("before").alias("key"), F.left("text", F.floor(F.col("n_before") / 3).cast("int")).alias("start"))
    following = own.join(order, "key").select(F.col("before").alias("key"), hashes("entries").alias("next_hashes"))
    kept = F.col("n") - F.floor(F.col("n") / 3)
    first = F.greatest(kept - (2 * window + gram - 2), F.lit(0))  # windows before first + window end before the change
    d = placed.join(starts, "key").withColumns({"text": F.concat(F.left("text", kept.cast("int")), "start"), "first": first})
    d = d.select("key", "doc_id", "times", "n", "first", F.sha2("text", 256).alias("edited_sha256"), F.expr("substring(text, cast(first AS int) + 1)").alias("text"))
    ends = fingerprints(d, gram=gram, window=window, block=block).withColumnRenamed("entries", "ends")
    d = d.drop("text").join(ends, "key").join(own, "key").join(following, "key")
    moved = F.transform("ends", lambda e: e + F.shiftleft("first", 32))
    before = F.filter("entries", lambda e: F.shiftright(e, 32) < F.col("first") + window)
    d = d.withColumn("edited", F.when(F.col("first") == 0, F.col("ends")).otherwise(F.array_sort(F.array_union(before, moved))))
    d = d.withColumns({"h": hashes("entries"), "e": hashes("edited")})
    d = d.withColumns({"near_edited": likeness(F.col("h"), F.col("e")), "near_next": likeness(F.col("h"), F.col("next_hashes"))})
    return d.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", "entries", "edited", "near_edited", "near_next")


def op11_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edited_fingerprints(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", "edited_sha256", shown("entries").alias("fingerprint"), shown("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def _oracle(gram: int = GRAM, window: int = WINDOW) -> str:
    """The query in SQL without a checksum function: a CRC is linear, so it is the exclusive or of what each bit at each place adds to that of zeros."""
    zeros = zlib.crc32(bytes(4 * gram))

    def share(place: int, bit: int) -> int:
        return zlib.crc32(bytes(4 * place) + (1 << bit).to_bytes(4, "big") + bytes(4 * (gram - place - 1))) ^ zeros

    def xors(terms: list[str]) -> str:
        return functools.reduce(lambda x, y: f"xor({x}, {y})", terms)

    shares = ", ".join(xors([f"(c >> {bit} & 1) * {share(j, bit)}" for bit in range(21)]) + f" AS t{j}" for j in range(gram))
    h = xors([f"{zeros}::BIGINT", "coalesce(t0, 0)", *[f"coalesce(lead(t{j}, {j}) OVER w, 0)" for j in range(1, gram)]])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, count(*) AS times, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS k FROM documents GROUP BY 1, 2),
e AS (SELECT d.*, length(text)::BIGINT AS n, coalesce(lead(text) OVER (ORDER BY k), (SELECT text FROM d WHERE k = 1)) AS after, coalesce(lead(k) OVER (ORDER BY k), 1) AS nk FROM d),
v AS (SELECT k, 0 AS v, text AS t FROM e UNION ALL SELECT k, 1, left(text, (n - n // 3)::BIGINT) || left(after, n // 3) FROM e),
l AS (SELECT k, v, list_resize(regexp_extract_all(t, '(?s).'), greatest(length(t), {gram})::BIGINT) AS chars FROM v WHERE t <> ''),
p AS (SELECT k, v, unnest(chars) AS ch, generate_subscripts(chars, 1)::BIGINT AS i, len(chars) AS n FROM l),
s AS (SELECT ch, {shares} FROM (SELECT ch, unicode(ch)::BIGINT AS c FROM (SELECT DISTINCT ch FROM p WHERE ch IS NOT NULL))),
g AS (SELECT k, v, i, n - {gram - 1} AS runs, {h} AS h FROM p LEFT JOIN s USING (ch) WINDOW w AS (PARTITION BY k, v ORDER BY i)),
m AS (SELECT k, v, i, runs, min(h * 1073741824 + (1073741823 - i)) OVER (PARTITION BY k, v ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS m FROM g WHERE i <= runs),
f AS (SELECT DISTINCT k, v, m >> 30 AS h, 1073741823 - (m & 1073741823) - 1 AS place FROM m WHERE i <= greatest(1, runs - {window - 1})),
a AS (SELECT k, v, string_agg(printf('%X', (place * 4294967296) + h), ',' ORDER BY place) AS shown, list_distinct(list(h)) AS hs FROM f GROUP BY k, v),
b AS (SELECT e.k, e.doc_id, e.times, e.n, left(text, (n - n // 3)::BIGINT) || left(after, n // 3) AS edited, coalesce(x.shown, '') AS one, coalesce(y.shown, '') AS two, coalesce(x.hs, []) AS hx, coalesce(y.hs, []) AS hy, coalesce(z.hs, []) AS hz
    FROM e LEFT JOIN a x ON x.k = e.k AND x.v = 0 LEFT JOIN a y ON y.k = e.k AND y.v = 1 LEFT JOIN a z ON z.k = e.nk AND z.v = 0)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, one AS fingerprint, two AS edited_fingerprint,
    CASE WHEN len(hx) + len(hy) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(hx, hy))::DOUBLE / len(list_distinct(list_concat(hx, hy))) END AS near_edited,
    CASE WHEN len(hx) + len(hz) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(hx, hz))::DOUBLE / len(list_distinct(list_concat(hx, hz))) END AS near_next
FROM b, unnest(range(times)) AS r(x)
"""


ORACLE = _oracle()
