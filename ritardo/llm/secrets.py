"""Secret scan: strong matches by pattern, weak ones only where complementary parts meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ritardo.llm.common import joined_spans, row_key


def _either(word: str) -> str:
    """The word with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _keyed(words: str, value: str) -> str:
    keys = "|".join(_either(w) for w in words.split())
    return rf"""(?:{keys})["']?\x20*[:=]\x20*["']?({value})"""


VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "weak_value", "weak_hex", "weak_token")
BASE = 3  # the first kinds are reported wherever they stand
#: kind -> pattern, least length of what is measured, whether that is group 1, role.
PATTERNS = {
    "assign": (_keyed("password passwd secret token api_?key", VALUE), 8, True, "secret"),
    "access": ("AKIA[A-Z0-9]+", 16, False, "id"),
    "hex": ("[0-9a-f]{32,}", 32, False, "secret"),
    "identifier": (_keyed("username user_?id user login account client_?id access_?key_?id",
                          "[A-Za-z0-9@._-]{3,}"), 3, True, "id"),
    "endpoint": (r"""(?:https?|ftp|ssh|mongodb|postgres|postgresql|mysql|redis|amqp)://[^\s"'<>]+|"""
                 + _keyed("hostname host endpoint server", "[A-Za-z0-9:._-]{4,}"), 4, False, "place"),
    "weak_value": (_keyed("password passwd secret token api_?key pass pwd auth", VALUE), 4, True,
                   "secret"),
    "weak_hex": ("(?<![0-9A-Za-z])[0-9a-f]{16,31}(?![0-9A-Za-z])", 16, False, "secret"),
    "weak_token": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])"
                   r"(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 20, False, "secret"),
}
SCOPE = 200  # code points between the starts of parts that belong together


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, k, s, e): matches of all kinds that are long enough, in code points.

    A text is cut at the matches; the lengths of the cuts and of the matches, summed in order,
    are the places. Rows of equal key are equal, so the copies are dropped.
    """
    d = docs.select(row_key(id_col, text_col).alias("key"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast("array<struct<k:int,i:int,gap:int,width:int,ok:boolean>>")

    def found(k: int, pattern: str, least: int, inner: bool) -> Column:
        cuts = F.split("t", pattern, -1)
        whole = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        part = F.regexp_extract_all("t", F.lit(pattern), F.lit(1)) if inner else whole
        rows = F.transform(whole, lambda m, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), F.length(F.get(cuts, i)).alias("gap"),
            F.length(m).alias("width"), (F.length(F.get(part, i)) >= least).alias("ok")))
        return F.when(F.col("t").rlike(pattern), rows).otherwise(none)

    rows = [found(k, p, n, g) for k, (p, n, g, _) in enumerate(PATTERNS.values())]
    m = d.select("key", F.inline(F.concat(*rows))).repartition("key").dropDuplicates(
        ["key", "k", "i"])
    upto = Window.partitionBy("key", "k").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("width")).over(upto).cast("bigint")
    return m.select("key", "k", "ok", end.alias("e"), (end - F.col("width")).alias("s")).where(
        "ok").select("key", "k", "s", "e")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: (key, k, s, e, other), ``other`` the start of a complementary part.

    Interval join of identifiers, secrets and places by start, within ``scope`` code points on
    either side, as a range frame, so no pairs are built. A strong part always stays. A weak
    secret needs an identifier or a place near it; a weak identifier or a place needs a secret.
    Weak parts that overlap a strong one or, among weak secrets, an earlier kind at the same
    start, are not reported.
    """
    roles = [p[3] for p in PATTERNS.values()]
    role = F.get(F.array(*[F.lit(r) for r in roles]), F.col("k"))
    p = parts.withColumns({"role": role, "strong": F.col("k") < BASE})
    before = Window.partitionBy("key").orderBy("s", "k", "e").rowsBetween(
        Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy("s", "k", "e").rowsBetween(
        1, Window.unboundedFollowing)
    covered = (F.max(F.when(F.col("strong"), F.col("e"))).over(before) > F.col("s")) | (
        F.min(F.when(F.col("strong"), F.col("s"))).over(after) < F.col("e")) | (
        (F.col("role") == "secret") & (F.max(F.when(
            (F.col("role") == "secret") & ~F.col("strong"), F.col("e"))).over(before) > F.col("s")))
    p = p.withColumn("covered", F.coalesce(covered, F.lit(False))).where("strong or not covered")
    near = Window.partitionBy("key").orderBy("s").rangeBetween(-scope, scope)

    def nearest(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("s"))).over(near)

    p = p.withColumns({"secret": nearest(F.col("role") == "secret"),
                       "other_part": nearest(F.col("role") != "secret")})
    other = F.when(F.col("role") == "secret", F.col("other_part")).otherwise(F.col("secret"))
    return p.withColumn("other", other).where("strong or other is not null").select(
        "key", "k", "s", "e", "other")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text"
         ) -> DataFrame:
    """Per document row: doc_id, key, ``spans`` array of struct(s, k, e), ``base`` those of the
    strong kinds. Both are empty for null, empty and clean texts. Repeated rows get equal results,
    extra columns are ignored, an empty table gives no rows.
    """
    hit = linked(candidates(docs, id_col, text_col), scope).groupBy("key").agg(F.array_sort(
        F.collect_set(F.struct("s", "k", "e"))).alias("spans"))
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    out = d.join(hit, "key", "left").withColumn("spans", F.coalesce("spans", none))
    return out.withColumn("base", F.filter("spans", lambda x: x["k"] < BASE))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the strong kinds, their checksum and all spans as text."""
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("bigint")

    counts = [count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:BASE])]
    return scanned.select("doc_id", *counts, F.sha2(joined_spans(F.col("base"), KINDS), 256).alias(
        "base_sha256"), joined_spans(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The documents with every reported span replaced by ``mask``; all rows and columns stay.

    Overlapping spans are cut to disjoint ones first; adjoining ones give one mask.
    """
    hit = linked(candidates(docs, id_col, text_col), scope)
    order = Window.partitionBy("key").orderBy("s", "e")
    sofar = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    isle = F.sum(F.when(F.col("s") > F.col("sofar"), 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flat = hit.withColumn("sofar", sofar).withColumn("isle", isle).groupBy("key", "isle").agg(
        F.min("s").alias("s"), F.max("e").alias("e"))
    per = flat.groupBy(F.col("key").alias("__key")).agg(F.array_sort(F.collect_list(
        F.struct("s", "e"))).alias("__cuts"))
    d = docs.withColumn("__key", row_key(id_col, text_col)).join(per, "__key", "left")
    t = F.col(text_col)

    def piece(x: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("__cuts", i - 1)["e"])
        return F.substring(t, (start + 1).cast("int"), (x["s"] - start).cast("int"))

    rest = F.substring(t, (F.element_at("__cuts", -1)["e"] + 1).cast("int"), F.lit(2147483647))
    new = F.concat(F.array_join(F.transform("__cuts", piece), mask), F.lit(mask), rest)
    return d.withColumn(text_col, F.when(F.col("__cuts").isNull(), t).otherwise(new)).select(
        *docs.columns)
