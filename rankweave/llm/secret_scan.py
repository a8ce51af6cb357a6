"""Secret scan weighed by corpus-wide ownership, in DataFrame functions only.

Base kinds are found by patterns. Beyond them, long mixed tokens are candidates. All
candidate values are hashed and their distinct repositories and owners are counted
over the whole corpus: a value that ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES``
repositories or more carry is an example that was copied about; a value of fewer that
looks live belongs to its owner and is reported as a span of kind ``owned``. Base spans
stay either way and carry the same verdict.

Only spans and hashes are written and shuffled, never text. The counts are three
nested aggregations with map-side combining (hash, owner, repository), so a value that
a third of all rows hold is reduced first; the join back is by hash, where adaptive
execution can split it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import configure, stage, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Further candidates; they must hold a digit, a letter and ``LIVE_DISTINCT`` different characters.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
LIVE_DISTINCT = 12
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|x{4,}|0{6,}|1234567"
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 50
#: Elements over which running values are built up by copying; longer arrays go block by block.
BLOCK = 256
KINDS = ("assign", "access", "hex", "owned")

_SPAN = "array<struct<start:int,stop:int,hit:string>>"


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each value what ``merge`` makes of all before it, from ``start`` on, in time linear in the values."""
    at = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
    grow = lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x)))
    blocks = F.transform(at, lambda k: F.aggregate(F.slice(values, k + 1, BLOCK), F.array(start), grow))
    before = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), F.array(start), grow)
    own = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: merge(o, v)))
    return F.flatten(own)


def spans_of(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with places in code points.

    The gaps that ``split`` leaves and the matches alternate, so places are running sums.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def placed(one: Column) -> Column:
        """``one`` binds the zipped matches, so that they are computed once."""
        ends = running(F.transform(one, lambda x: x["gap"] + F.length(x["hit"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(one, ends, lambda x, e: F.struct(
            (e + x["gap"]).alias("start"), (e + x["gap"] + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit")))

    found = F.flatten(F.transform(F.array(zipped), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def apart_from(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, both (start, rank, stop, hash); others rank lower."""
    top = F.lit(2**31 - 1)

    def lone(every: Column) -> Column:
        stops = F.transform(every, lambda s: F.when(s["rank"] < 3, s["stop"]).otherwise(0))
        starts = F.transform(F.reverse(every), lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(top))
        behind, ahead = running(stops, F.lit(0), F.greatest), F.reverse(running(starts, top, F.least))
        sides = F.zip_with(behind, ahead, lambda b, a: F.struct(b.alias("behind"), a.alias("ahead")))
        free = F.zip_with(every, sides, lambda s, x: F.struct(
            s.alias("s"), ((s["rank"] == 3) & (x["behind"] <= s["start"]) & (x["ahead"] >= s["stop"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"])

    found = F.flatten(F.transform(F.array(F.array_sort(F.concat(others, spans))), lone))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), found).otherwise(spans)


def _tagged(spans: Column, rank: int, value=lambda h: h) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.sha2(value(s["hit"]), 256).alias("hash")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, base and all spans (start, rank, stop,
    hash), ``weighed`` (all spans with owners, repositories and whether they are widely
    copied), and how many base spans are owner-specific or widely copied.

    Null and empty texts have no spans. A null owner is one unnamed owner. Repeated rows
    are scanned each for itself and count once in the ownership. Columns not in ``keep``
    are dropped; their names can't clash.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    value = lambda h: F.regexp_extract(h, ASSIGN, 2)
    assign = F.filter(spans_of(text, ASSIGN), lambda s: F.length(value(s["hit"])) >= 8)
    live = F.filter(spans_of(text, TOKEN), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]") & ~s["hit"].rlike(PLACEHOLDER)
                    & (F.size(F.array_distinct(F.split(s["hit"], ""))) >= LIVE_DISTINCT))
    found = stage(
        docs.select(
            F.monotonically_increasing_id().alias("__rid"), *[docs[c] for c in keep],
            F.coalesce(docs[owner].cast("string"), F.lit("")).alias("__owner"), F.coalesce(docs[repository].cast("string"), F.lit("")).alias("__repo"),
            _tagged(assign, 0, value).alias("__assign"), _tagged(spans_of(text, ACCESS), 1).alias("__access"),
            _tagged(spans_of(text, HEX), 2).alias("__hex"), _tagged(live, 3).alias("__live"),
        ),
        "secret-spans",
    )
    base = F.concat("__assign", "__access", "__hex")
    found = found.withColumn("__base", base).withColumn("__live", apart_from(F.col("__live"), F.col("__base")))
    each = found.select("__rid", "__owner", "__repo", F.explode(F.concat("__base", "__live")).alias("s"))
    owners = (
        each.select(F.col("s.hash").alias("hash"), "__owner", "__repo").distinct()
        .groupBy("hash", "__owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    wide = (F.col("owners") >= WIDE_OWNERS) | (F.col("repos") >= WIDE_REPOSITORIES)
    told = F.struct("s.start", "s.rank", "s.stop", "s.hash", "owners", "repos", wide.alias("wide"))
    weighed = each.withColumn("hash", F.col("s.hash")).join(owners, "hash").groupBy("__rid").agg(F.array_sort(F.collect_list(told)).alias("__told"))
    span = found.schema["__base"].dataType
    own = F.filter("__told", lambda s: (s["rank"] == 3) & ~s["wide"])
    plain = F.size("__base") + F.size("__live") == 0
    some = found.where(~plain).join(weighed, "__rid")
    nothing = F.array().cast(some.schema["__told"].dataType)
    columns = lambda told, owned: [
        *[F.col(c) for c in keep], *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.col("__base").alias("base"),
        F.concat("__base", owned).alias("all_spans"), F.filter(told, lambda s: (s["rank"] < 3) | ~s["wide"]).alias("weighed"),
        F.size(F.filter(told, lambda s: (s["rank"] < 3) & s["wide"])).cast("long").alias("n_widely_copied"),
        F.size(F.filter(told, lambda s: (s["rank"] < 3) & ~s["wide"])).cast("long").alias("n_owner_specific"),
    ]
    owned = F.transform(own, lambda s: F.struct(*[s[n].alias(n) for n in span.elementType.names]))
    return found.where(plain).select(*columns(nothing, F.array().cast(span))).unionByName(some.select(*columns(F.col("__told"), owned)))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``; null stays null.

    Spans are cut out block by block, each block from its own stretch of the text, so
    that the text is not walked from its start for every span.
    """
    def cut(every: Column) -> Column:
        at = running(F.transform(every, lambda s: s["stop"]), F.lit(0), F.greatest)
        return F.zip_with(every, at, lambda s, a: F.struct(a.alias("at"), s["start"].alias("start"), F.greatest(a, s["stop"]).alias("end")))

    def stretch(b: Column) -> Column:
        base = F.element_at(b, 1)["at"]
        return F.struct(b.alias("cuts"), base.alias("base"), F.substring(text, base + 1, F.element_at(b, -1)["end"] - base).alias("own"))

    def piece(r: Column, c: Column) -> Column:
        gap = F.substring(r["own"], c["at"] - r["base"] + 1, c["start"] - c["at"])
        return F.when(c["start"] < c["at"], F.lit("")).otherwise(F.concat(gap, F.lit(mark)))

    def without(cuts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1, F.lit(BLOCK)), lambda k: F.slice(cuts, k + 1, BLOCK))
        parts = F.transform(F.transform(blocks, stretch), lambda r: F.array_join(F.transform(r["cuts"], lambda c: piece(r, c)), ""))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))

    bound = F.transform(F.array(F.array_sort(spans)), cut)
    return F.when(F.size(spans) > 0, F.element_at(F.transform(bound, without), 1)).otherwise(text)


def _verdicts(weighed: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(weighed, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"), F.when(s["wide"], "copied").otherwise("owned"),
        s["owners"].cast("string"), s["repos"].cast("string"))), ",")


def op6_secret_ownership(spark, sf_dir):
    """Secrets of all documents; ``verdicts`` has each span's kind, place, verdict, owners and repositories.

    Null and empty texts have none. Owners are sources (null: one unnamed owner),
    repositories documents; repeated rows count once. Spans that start together stand
    in the order of kinds.
    """
    configure(spark)
    got = scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.col("all_spans")).alias("spans"), _verdicts(F.col("weighed")).alias("verdicts"), "n_widely_copied", "n_owner_specific")


def _sql() -> str:
    # DuckDB's (?i) also folds letters beyond ASCII, so the words are spelled in both cases
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", f"({words})")

    def spans(rank: int, pattern: str, where: str) -> str:
        p = pattern.replace("'", "''")
        return (
            f"SELECT doc_id, source, {rank} AS rank, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + "
            f"coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS a FROM (SELECT doc_id, source, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM "
            f"(SELECT doc_id, source, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d)) WHERE {where}"
        )

    value = "regexp_extract(hit, '{}', 2)".format(assign.replace("'", "''"))
    live = (f"regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '{PLACEHOLDER}') "
            f"AND len(list_distinct(string_split(hit, ''))) >= {LIVE_DISTINCT}")
    kinds = "CASE rank " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
    key = f"{kinds} || ':' || a || ':' || b"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({spans(0, assign, f"length({value}) >= 8")} UNION ALL {spans(1, ACCESS, "true")} UNION ALL {spans(2, HEX, "true")} UNION ALL {spans(3, TOKEN, live)}),
placed AS (SELECT doc_id, coalesce(source, '') AS owner, rank, a::BIGINT AS a, (a + length(hit))::BIGINT AS b, CASE rank WHEN 0 THEN {value} ELSE hit END AS v FROM found),
apart AS (SELECT * FROM placed p WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM placed q WHERE q.doc_id = p.doc_id AND q.rank < 3 AND q.a < p.b AND p.a < q.b)),
owners AS (SELECT v, count(DISTINCT owner) AS o, count(DISTINCT (owner, coalesce(doc_id::VARCHAR, ''))) AS r, o >= {WIDE_OWNERS} OR r >= {WIDE_REPOSITORIES} AS wide FROM apart GROUP BY v),
sums AS (SELECT doc_id, count(*) FILTER (rank = 0) AS x, count(*) FILTER (rank = 1) AS y, count(*) FILTER (rank = 2) AS z,
  string_agg({key}, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg({key}, ',' ORDER BY a, rank) FILTER (rank < 3 OR NOT wide) AS spans,
  string_agg({key} || CASE WHEN wide THEN ':copied:' ELSE ':owned:' END || o || ':' || r, ',' ORDER BY a, rank) FILTER (rank < 3 OR NOT wide) AS verdicts,
  count(*) FILTER (rank < 3 AND wide) AS w, count(*) FILTER (rank < 3 AND NOT wide) AS s FROM apart JOIN owners USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(x, 0)::BIGINT AS n_assign, coalesce(y, 0)::BIGINT AS n_access, coalesce(z, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts, coalesce(w, 0)::BIGINT AS n_widely_copied, coalesce(s, 0)::BIGINT AS n_owner_specific FROM d LEFT JOIN sums USING (doc_id)"""


OP6_SQL = _sql()
