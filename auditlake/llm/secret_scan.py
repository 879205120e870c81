"""Secret scan: patterns find candidates in whole texts, and how many owners share a value says what it is.

Three base patterns (an assignment to a credential's name, an access key, a long hex run) and one of bare mixed
tokens find candidate values. Each value's digest is counted over the whole corpus by distinct repositories and
distinct owners: first by (value, owner, repository), then by (value, owner), then by value, each step added up in
the tasks before it is shuffled, so a value that a third of all documents hold is one row a task. A value that more than
`max_owners` owners hold, or that a placeholder word marks, is a widely copied `example`; one that few owners hold and
that varies as credentials do is `live`; the rest is `plain`. Base spans are reported whatever the verdict; bare
tokens only where they are live.

Positions come from the gaps between matches (what `split` leaves) and the matches themselves, added up along the
text, in code points. Only built-in functions run, and values leave a task as digests only.

Defined results: a null or empty text has no spans; rows repeated with the same id and text each get that
text's result and each count as a place, their owners and repositories as they are; a null owner or repository is
one of its own; equal values at several places are counted at each; spans of different kinds may overlap and of equal starts
the order is that of KINDS; very long texts are scanned whole; an empty table gives none; columns other than the four named don't
reach the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm._shared import let, stored, text_key

# Names of credentials in assignments, letters in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "bare")
# Words that mark a value as a placeholder.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "12345678")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = rf"""({"|".join(map(_either_case, NAMES))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Matches of the other kinds are taken first, so a bare token is none of them.
MIXED = r"[A-Za-z0-9_-]{20,}"
BARE = rf"{ASSIGN}|AKIA[A-Z0-9]{{16,}}|[0-9a-f]{{24,}}|{MIXED}"
# Least lengths of the values of each kind.
LEAST = {"assign": 6, "access": 20, "hex": 24}

EMPTY = "array<struct<start:bigint,order:int,end:bigint,value:string>>"


def running_totals(lengths: Column) -> Column:
    """Sums up to each element, in blocks of about the root of their number, so that arrays being built stay short."""

    def scan(xs):
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))
        return F.aggregate(xs, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    def whole(xs):
        step = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(xs)))).cast("int")
        starts = F.sequence(F.lit(0), F.size(xs) - 1, step)
        return let(F.transform(starts, lambda at: scan(F.slice(xs, at + 1, step))), moved)

    def moved(blocks):
        return let(
            scan(F.transform(blocks, lambda b: F.element_at(b, -1))),
            lambda ends: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))))),
        )

    return let(lengths, whole)


def matches(text: Column, pattern: str, holds: str, kind: str, value_of, wanted) -> Column:
    """array<struct<start, order, end, value>> of the pattern's leftmost non-overlapping matches whose value is wanted.

    holds: a pattern that any text with a wanted value has; texts without it aren't searched further.
    """
    order = KINDS.index(kind)

    def placed(hits, gaps):
        size = lambda s: F.length(s).cast("long")
        steps = F.transform(hits, lambda h, i: size(h) + size(F.get(gaps, i)))
        ends = running_totals(steps)
        span = lambda h, end: F.struct((end - size(h)).alias("start"), F.lit(order).alias("order"), end.alias("end"), value_of(h).alias("value"))
        return F.filter(let(ends, lambda es: F.transform(hits, lambda h, i: span(h, F.get(es, i)))), lambda s: wanted(s["value"]))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps)))
    return F.coalesce(F.when(text.rlike(holds), found), F.array().cast(EMPTY))


def varied(value: Column, least: int) -> Column:
    """Whether a value has that many different characters."""
    return F.size(F.array_distinct(F.split(value, ""))) >= least


def candidate_spans(text: Column) -> Column:
    """All candidates of a text that isn't null, kind by kind."""
    long_enough = lambda kind: lambda v: F.length(v) >= LEAST[kind]
    mixed = lambda v: v.rlike(f"^{MIXED}$") & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]") & ~v.rlike(f"^({ACCESS}|{HEX})$")
    return F.concat(
        matches(text, ASSIGN, ASSIGN, "assign", lambda h: F.regexp_extract(h, f"^{ASSIGN}$", 2), long_enough("assign")),
        matches(text, ACCESS, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "access", lambda h: h, long_enough("access")),
        matches(text, HEX, f"[0-9a-f]{{{LEAST['hex']},}}", "hex", lambda h: h, long_enough("hex")),
        matches(text, BARE, MIXED, "bare", lambda h: h, mixed),
    )


def ownership(places: DataFrame) -> DataFrame:
    """sha256, n_places, n_repositories, n_owners of every value: places has sha256, owner, repository, a row a place."""
    by_repository = places.groupBy("sha256", "owner", "repository").agg(F.count("*").alias("n_places"))
    by_owner = by_repository.groupBy("sha256", "owner").agg(F.sum("n_places").alias("n_places"), F.count("*").alias("n_repositories"))
    return by_owner.groupBy("sha256").agg(F.sum("n_places").alias("n_places"), F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = 2,
    least_distinct: int = 10,
) -> DataFrame:
    """id and spans of every row: array<struct<start, order, end, kind, sha256, n_places, n_repositories, n_owners, verdict>>, in order.

    owner and repository are columns of docs (null: one unknown of its own); without them all rows have one owner.
    """
    none = F.lit(None).cast("string")
    owner, repository = none if owner is None else owner, none if repository is None else repository
    text = F.col(text_col)
    looks = lambda v: varied(v, least_distinct) & ~F.lower(v).rlike("|".join(PLACEHOLDERS))
    digested = F.transform(
        candidate_spans(F.coalesce(text, F.lit(""))),
        lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("sha256"), looks(s["value"]).alias("looks"), F.lower(s["value"]).rlike("|".join(PLACEHOLDERS)).alias("placeholder")),
    )
    found = stored(docs.select(F.col(id_col).alias("_id"), text_key(text).alias("_key"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), digested.alias("found")))
    each = found.where(F.size("found") > 0).select("_id", "_key", "owner", "repository", F.explode("found").alias("s")).select("_id", "_key", "owner", "repository", "s.*")

    shared = F.col("placeholder") | (F.col("n_owners") > max_owners)
    verdict = F.when(shared, "example").when(F.col("looks"), "live").otherwise("plain")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    judged = each.join(ownership(each), "sha256").withColumns({"verdict": verdict, "kind": kind}).where((F.col("kind") != "bare") | (F.col("verdict") == "live"))
    span = F.struct("start", "order", "end", "kind", "sha256", "n_places", "n_repositories", "n_owners", "verdict")
    by_text = judged.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(span)).alias("spans")).withColumnsRenamed({"_id": "_sid", "_key": "_skey"})
    kind_of_spans = dict(by_text.dtypes)["spans"]
    joined = found.select("_id", "_key").join(by_text, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_key") == F.col("_skey")), "left")
    return joined.select(F.col("_id").alias(id_col), F.coalesce("spans", F.array().cast(kind_of_spans)).alias("spans"))
