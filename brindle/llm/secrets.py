"""Secret scans: patterns per text, then corpus-wide ownership frequency.

Patterns find candidate spans in each text. Candidate values (as hashes; the
values themselves leave the row nowhere) are counted over the corpus by
distinct repositories and distinct owners. A value that many owners hold is a
widely copied example; one that few owners hold and that looks random is
owner-specific and probably live.

The patterns of :data:`BASE` report every span they match. The wider pattern
:data:`GENERIC` is too eager alone: its spans are added, as kind ``owned``, only
where the ownership count calls the value live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    group: int
    least: int


BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of 32 or more is a run that passes: shorter ones need not be listed.
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Whole tokens of 20 characters or more with a digit and letters of both cases.
GENERIC = Kind("owned", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})(?=[A-Za-z_-]*[0-9])(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])[A-Za-z0-9_-]+", 0, 20)
#: Values held by more owners, or in more repositories, are examples.
MAX_OWNERS = 2
MAX_REPOS = 16
#: A live-looking value has this many different characters at least.
LEAST_CHARACTERS = 8
#: Matches whose places are summed together.
TOGETHER = 128

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(kind: Kind) -> dict[str, Column]:
    """The matches of one kind and, only where there are any, what lies between."""
    t, m = F.col("__t"), F.col(f"__m_{kind.name}")
    return {
        f"__g_{kind.name}": F.when(F.size(m) > 0, F.split(t, kind.pattern, -1)),
        f"__v_{kind.name}": F.when(F.size(m) > 0, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(kind.group))) if kind.group else m,
    }


def _spans(kind: Kind) -> Column:
    """Places of the matches in code points: running sums over gaps and matches.

    Appending to an array copies it, so sums run over ``TOGETHER`` matches, and
    then over those parts.
    """
    m, g, v = (F.col(f"__{x}_{kind.name}") for x in "mgv")
    n, empty = F.size(m), F.array().cast("array<int>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(g, i))
        return F.struct((start + F.length(F.get(m, i))).alias("at"), F.array_append(acc["starts"], start).alias("starts"))

    def part(acc: Column, p: Column) -> Column:
        places = F.sequence(p * TOGETHER, F.least(n, (p + 1) * TOGETHER) - 1)
        own = F.aggregate(places, F.struct(F.lit(0).alias("at"), empty.alias("starts")), step)
        # One place for the sums of a part, which are used twice.
        return F.transform(F.array(own), lambda x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["parts"], F.transform(x["starts"], lambda s: s + acc["at"])).alias("parts")))[0]

    last = F.floor((n - 1) / TOGETHER).cast("int")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    starts = F.flatten(F.aggregate(F.sequence(F.lit(0), last), zero, part)["parts"])
    found = F.transform(starts, lambda s, i: F.struct(s.alias("start"), (s + F.length(F.get(m, i))).alias("end"), F.get(v, i).alias("value")))
    return F.when(n > 0, F.filter(found, lambda s: F.length(s["value"]) >= kind.least)).otherwise(F.array().cast(_SPAN))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, repo, owner, spans): every candidate span of every text.

    ``spans`` is sorted by start, then kind (its place in ``BASE + (GENERIC,)``);
    a value is kept as its MD5 and its number of different characters. A null
    text counts as an empty one and has no spans. Nothing is shuffled.
    """
    kinds = (*BASE, GENERIC)
    out = df.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    out = out.withColumns({f"__m_{k.name}": F.regexp_extract_all(F.col("__t"), F.lit(k.pattern), F.lit(0)) for k in kinds})
    out = out.withColumns({n: c for k in kinds for n, c in _matches(k).items()})

    def described(kind: int, spans: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(kind).alias("kind"),
                s["end"].alias("end"),
                F.md5(s["value"].cast("binary")).alias("hash"),
                F.size(F.array_distinct(F.split(s["value"], ""))).alias("characters"),
            ),
        )

    spans = F.concat(*(described(i, _spans(k)) for i, k in enumerate(kinds)))
    return out.select("doc_id", "repo", "owner", F.sort_array(spans).alias("spans"))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in (*BASE, GENERIC)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of every candidate value of the corpus.

    Spark counts the distinct pairs first, so a value that fills a third of
    the corpus is spread over its owners and repositories. Null owners and
    repositories count as one of each.
    """
    one = scanned.select(F.explode("spans").alias("s"), "repo", "owner").select("s.hash", F.coalesce("repo", F.lit("\0")).alias("repo"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    return one.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"))


def secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per row of ``df``, repeated rows and null ids included.

    ``n_assign``, ``n_access``, ``n_hex``: base spans by kind; ``n_live``: spans
    whose value is owner-specific and live-looking; ``n_example``: spans whose
    value is widely copied; ``base_spans`` and ``spans``: ``kind:start:end`` by
    start, comma-joined ('' for none). A null text counts as an empty one, a null
    owner or repository as one of its own; an empty table gives an empty result.
    Texts of any length are searched whole, in time close to linear. They are read
    once and are not shuffled; only the spans are.
    """
    scanned = cut(scan(df, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & (F.col("s.characters") >= LEAST_CHARACTERS)
    example = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    generic = F.col("s.kind") == len(BASE)
    judged = (
        scanned.select("row", F.explode("spans").alias("s"))
        # Cut, so that the join deals out both sides and Spark can split a value of many copies.
        .join(cut(ownership(scanned)), F.col("s.hash") == F.col("hash"))
        .groupBy("row")
        .agg(
            F.count_if(live).alias("n_live"),
            F.count_if(example & ~generic).alias("n_example"),
            F.collect_list(F.when(generic & live, F.struct("s.start", "s.kind", "s.end"))).alias("added"),
        )
    )
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.filter(plain, lambda s: s["kind"] < len(BASE))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = scanned.select("doc_id", "row", base.alias("__base")).join(judged, "row", "left")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        _text(F.col("__base")).alias("base_spans"),
        _text(F.sort_array(F.concat("__base", F.coalesce("added", none)))).alias("spans"),
    )
