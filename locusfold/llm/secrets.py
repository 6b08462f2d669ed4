"""Secret scans with multipart credential linking, by DataFrame functions only.

Each pattern is matched once over the whole text: the pieces between the matches give their
positions, by a running sum over the matches of a text. Strong kinds are always reported. The
weak kinds (identifiers, random-looking tokens and endpoints) are reported only where the other
parts of a credential lie within the same scope: an interval join, binned by position, as a
semi-join, so that no pairs are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Spans that a broadcast of the spans of whole texts may hold (16 bytes each and 64 a text); beyond it they are joined by a shuffle.
BROADCAST_SPANS = 1 << 20

#: Characters between two parts of one credential.
SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
_IDS = "|".join(map(_any_case, ("client", "account", "access", "tenant", "user")))

#: kind: (pattern, least length of what counts, strong). The order is the order of ties.
KINDS: dict[str, tuple[str, int, bool]] = {
    "assign": (rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, True),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, True),
    "hex": (r"[0-9a-f]{32,}", 32, True),
    "ident": (rf"""({_IDS})[_-]?[Ii][Dd]["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 4, False),
    "blob": (r"[A-Za-z0-9+/_=-]{20,}", 20, False),
    "endpoint": (r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 10, False),
}
#: What part of a credential a kind is, and what must lie in scope: (any of these parts, how many of them).
PARTS = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "ident": "id", "endpoint": "endpoint"}
NEEDS = {"ident": (("secret",), 1), "blob": (("id", "endpoint"), 1), "endpoint": (("id", "secret"), 2)}
_VALUE = {"assign": 2, "ident": 2}


def _found(text: Column, pattern: str) -> Column:
    """Array of (gap before the match in characters, match); null without a match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")))


def _counts(kind: str) -> Column:
    """Whether a match of this kind counts."""
    pattern, least, _ = KINDS[kind]
    value = F.regexp_extract("hit", pattern, _VALUE[kind]) if kind in _VALUE else F.col("hit")
    ok = F.length(value) >= least
    if kind == "blob":  # random-looking: letters of both cases and digits
        for part in ("[a-z]", "[A-Z]", "[0-9]"):
            ok &= value.rlike(part)
    return ok


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has every row of `docs` as (row, doc_id); spans has (row, kind, start, end, strong),
    in characters of the whole text, end exclusive.

    A null text counts as empty; null and repeated ids are rows of their own; other columns are ignored.
    """
    kinds = list(KINDS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        *[_found(text, KINDS[k][0]).alias(k) for k in kinds],
    ))
    by_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in kinds])
    hits = base.select("row", F.explode(by_kind).alias("k")).select(
        "row", "k.kind", F.posexplode("k.found").alias("n", "f")
    ).select("row", "kind", "n", F.col("f.gap").alias("gap"), F.col("f.hit").alias("hit"))
    upto = Window.partitionBy("row", "kind").orderBy("n")
    placed = hits.select(
        "row", "kind", "hit", F.sum(F.col("gap") + F.length("hit")).over(upto).alias("end")
    ).withColumn("start", F.col("end") - F.length("hit"))
    ok = F.lit(False)
    for k in kinds:
        ok |= (F.col("kind") == k) & _counts(k)
    strong = F.col("kind").isin([k for k in kinds if KINDS[k][2]])
    parts = materialize(placed.filter(ok).select("row", "kind", "start", "end", strong.alias("strong")))
    return base.select("row", "doc_id"), parts.filter("strong").unionByName(linked(parts))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans whose complementary parts lie within `scope` characters and do not overlap them."""
    part, needs, least = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(0)
    for k, name in PARTS.items():
        part = F.when(F.col("kind") == k, name).otherwise(part)
    for k, (names, n) in NEEDS.items():
        needs = F.when(F.col("kind") == k, F.array(*map(F.lit, names))).otherwise(needs)
        least = F.when(F.col("kind") == k, n).otherwise(least)

    def bins(margin: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col("start") - margin) / scope), F.floor((F.col("end") + margin) / scope)))

    weak = parts.filter("not strong").select("row", "kind", "start", "end", "strong", F.explode(needs).alias("part")).withColumn("bin", bins(0))
    near = parts.select("row", part.alias("p_part"), "start", "end").withColumn("bin", bins(scope)).select(
        F.col("row").alias("p_row"), F.col("bin").alias("p_bin"), "p_part", F.col("start").alias("p_start"), F.col("end").alias("p_end")
    )
    met = weak.join(
        near,
        (F.col("row") == F.col("p_row")) & (F.col("bin") == F.col("p_bin")) & (F.col("part") == F.col("p_part"))
        & (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") >= F.col("start") - scope)
        & ((F.col("p_end") <= F.col("start")) | (F.col("p_start") >= F.col("end"))),
        "left_semi",
    )
    return (
        met.groupBy("row", "kind", "start", "end", "strong").agg(F.countDistinct("part").alias("n"))
        .filter(F.col("n") >= least).drop("n")
    )


def scan_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the strong kinds, digest of the strong spans, all spans as text; see `spans`."""
    rows, found = spans(docs, id_col=id_col, text_col=text_col)
    order = F.lit(0)
    for i, k in enumerate(KINDS):
        order = F.when(F.col("kind") == k, i).otherwise(order)
    item = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("span"), "strong")
    grouped = found.groupBy("row").agg(
        F.array_sort(F.collect_list(item)).alias("all"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS if KINDS[k][2]],
    )

    def text(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["span"]), ",")

    none = F.array().cast("array<struct<start:bigint,order:int,span:string,strong:boolean>>")
    everything = F.coalesce("all", none)
    return rows.join(grouped, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS if KINDS[k][2]],
        F.sha2(text(F.filter(everything, lambda x: x["strong"])).cast("binary"), 256).alias("base_sha256"),
        text(everything).alias("spans"),
    )


def mask(docs: DataFrame, replacement: str = "[SECRET]") -> DataFrame:
    """`docs` (doc_id, text, ...) with every reported span replaced, n_chars counted anew.

    Rows without a span, and null texts, are passed on as they are; equal rows stay as many; an empty
    table stays empty. Other columns are passed on.
    """
    key = F.struct("doc_id", F.xxhash64("text"), F.octet_length("text"))
    once = docs.select(key.alias("doc_id"), "text")
    rows, found = spans(once)
    # overlapping spans become one run
    w = Window.partitionBy("row").orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        found.withColumn("new", F.coalesce(F.col("start") > top, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(w)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    )
    # equal rows have equal spans, so one of each key is enough
    hit = materialize(runs.join(rows, "row").groupBy(F.col("doc_id").alias("key")).agg(F.any_value("_runs").alias("runs")))
    size = hit.agg(F.coalesce(F.sum(F.size("runs") + 4), F.lit(0))).first()[0]
    runs_, text = F.col("runs"), F.col("row.text")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs_, lambda r: r["end"]))
    ends = F.concat(F.transform(runs_, lambda r: r["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    masked = F.when(runs_.isNull(), text).otherwise(F.array_join(kept, replacement))
    joined = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(F.broadcast(hit) if size <= BROADCAST_SPANS else hit, "key", "left")
    return joined.select("row", masked.alias("masked")).select(
        *[F.col("masked").alias(c) if c == "text" else F.length("masked").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    )


def report_sql(scope: int = SCOPE) -> str:
    """DuckDB SQL for `scan_report` over the view documents."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    each, ok = [], []
    for i, (k, (pattern, least, strong)) in enumerate(KINDS.items()):
        p = quoted(pattern)
        each.append(
            f"SELECT rid, '{k}' AS kind, {i} AS ord, {str(strong).lower()} AS strong, '{PARTS[k]}' AS part, "
            f"regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS s FROM d"
        )
        value = f"regexp_extract(hit, {p}, {_VALUE[k]})" if k in _VALUE else "hit"
        test = f"length({value}) >= {least}"
        if k == "blob":
            test += f" AND regexp_matches({value}, '[a-z]') AND regexp_matches({value}, '[A-Z]') AND regexp_matches({value}, '[0-9]')"
        ok.append(f"(kind = '{k}' AND {test})")
    need = " OR ".join(
        f"(w.kind = '{k}' AND p.part IN ({', '.join(map(quoted, names))}))" for k, (names, _) in NEEDS.items()
    )
    least = " ".join(f"WHEN kind = '{k}' THEN {n}" for k, (_, n) in NEEDS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({' UNION ALL '.join(each)}),
e AS (SELECT rid, kind, ord, strong, part, unnest(range(1, len(m) + 1)) AS i, m, s FROM k WHERE len(m) > 0),
h AS (SELECT rid, kind, ord, strong, part, i, m[i] AS hit, length(s[i]) AS gap FROM e),
a AS (SELECT rid, kind, ord, strong, part, hit,
        sum(gap + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT AS "end" FROM h),
p AS (SELECT rid, kind, ord, strong, part, "end" - length(hit) AS start, "end" FROM a WHERE {' OR '.join(ok)}),
n AS (SELECT w.rid, w.kind, w.ord, w.start, w."end", count(DISTINCT p.part) AS n FROM p w JOIN p ON w.rid = p.rid
        AND p.start <= w."end" + {scope} AND p."end" >= w.start - {scope} AND (p."end" <= w.start OR p.start >= w."end")
        AND ({need}) WHERE NOT w.strong GROUP BY ALL),
f AS (SELECT rid, kind, ord, start, "end", true AS strong FROM p WHERE strong
      UNION ALL SELECT rid, kind, ord, start, "end", false FROM n WHERE n >= CASE {least} END),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) FILTER (strong) AS b,
        string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
