"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns; each candidate value is hashed, and for each
hash the corpus is asked how many distinct repositories and owners hold it. A
value that many owners hold, or very many repositories, is a widely copied example;
one that few hold and that looks drawn at random is somebody's live credential, and
all others are placeholders.

Positions: splitting a text by a pattern gives the gaps between the leftmost
non-overlapping matches, so running sums of gap and match lengths are the spans.
The running sums are a window over the (few) candidates of one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, with_class


@dataclass(frozen=True)
class Kind:
    """A pattern with the group that holds the value and the least length of that group."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: The base patterns of the contract, in its order, then the method's own kind.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs under 24 can be left out at once: a run is one match whatever its length
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
    # bare tokens that mix cases and digits; kept as spans only where few owners hold them
    Kind("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 0, 20, base=False),
)

#: A value held by at least this many distinct owners, or repositories, is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 50
#: A live value has at least so many different characters, a digit (or the mark of an access key), and no word that stands for a value.
DIFFERENT = 6
STANDS_FOR = r"(?i)change.?me|example|sample|dummy|placeholder|your|xxxx|\*\*\*|test|1234567|abcdef$|password|secret"


def live(value: Column) -> Column:
    """Whether a value looks drawn at random."""
    mixed = (value.rlike("[0-9]") | value.rlike("^AKIA")) & ~value.rlike(STANDS_FOR)
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)


def _matches(text: Column, rank: int, kind: Kind) -> Column:
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    gaps = F.split(text, kind.pattern, -1)
    found = F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g"), F.sequence(F.lit(1), F.size(whole)).alias("i")),
        lambda x: F.struct(F.lit(rank).alias("kind"), x["i"].alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("chars"), F.sha2(x["v"], 256).alias("digest"), live(x["v"]).alias("live")),
    )
    return F.when(text.rlike(kind.pattern), found)


def candidates(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None, row_col: str | None = None) -> DataFrame:
    """One row per candidate, and one with a null kind for each row of `docs` without any.

    `row` tells rows of `docs` apart, also those with equal or null ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        (F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")).alias("owner"),
        (F.col(repo_col).cast("string") if repo_col else F.col(id_col).cast("string")).alias("repo"),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,chars:int,digest:string,live:boolean>>")
    every = F.concat(*[F.coalesce(_matches(text, rank, k), none) for rank, k in enumerate(KINDS)])
    found = base.select("row", "id", "owner", "repo", F.explode_outer(every).alias("c"))
    return found.select("row", "id", "owner", "repo", "c.*")


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners over the corpus.

    Rows are combined by (hash, owner, repository) before each shuffle, so a value
    that a third of all rows hold sends one row a task and repository.
    """
    enough = F.lit(False)
    for rank, k in enumerate(KINDS):
        enough = enough | ((F.col("kind") == rank) & (F.col("chars") >= k.least))
    by_repo = found.where(enough).groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, row_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per row of `docs`: id, row, secrets (array of kind, start, end, base, n_owners, n_repos, verdict).

    start and end are code points. verdict is 'example' for a value with at least
    `example_owners` owners or `example_repos` repositories, 'owned' for another that
    looks live, else 'placeholder'. The repository of a row is `repo_col`, or the
    document itself; `row_col` is a unique row number, made here if not given. A null
    owner counts as one owner of its own. Null and empty texts have no secrets, however
    long a text is all of it is read, and rows with equal ids stay separate rows. Spans
    that start at one place come in the order of the kinds. An empty table gives none.

    Texts are read once: the candidates (hashes and places, no values) go to a table.
    """
    found = checkpointed(candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col, row_col=row_col))
    some = found.where("kind is not null")
    told = with_class(some, ownership(some), ["digest"], "n_places")
    at = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = told.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(at))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    is_base = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("kind") + 1)
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdict = F.when(example, "example").when(F.col("live"), "owned").otherwise("placeholder")
    stays = (F.col("chars") >= least) & (is_base | (verdict == "owned"))
    secret = F.struct(
        (F.col("end") - F.col("size")).alias("start"), F.col("kind").alias("rank"), F.col("end").alias("end"),
        is_base.alias("base"), F.col("n_owners").alias("n_owners"), F.col("n_repos").alias("n_repos"), verdict.alias("verdict"),
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,base:boolean,n_owners:bigint,n_repos:bigint,verdict:string>>")
    grouped = placed.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(stays, secret))).alias("s"))
    grouped = grouped.unionByName(found.where("kind is null").select("row", "id", none.alias("s")))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    # a span of the method's own kinds goes where a base span covers any of it
    free = F.filter("s", lambda x: x["base"] | ~F.exists("s", lambda y: y["base"] & (y["start"] < x["end"]) & (x["start"] < y["end"])))
    out = F.transform(free, lambda x: F.struct(F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["n_owners"].alias("n_owners"), x["n_repos"].alias("n_repos"), x["verdict"].alias("verdict")))
    return grouped.select(F.col("id").alias(id_col), F.col("row"), out.alias("secrets"))


def suspicious(text: Column) -> Column:
    """Whether any pattern matches at all."""
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | text.rlike(k.pattern)
    return F.coalesce(hit, F.lit(False))


def mask(docs: DataFrame, **options) -> DataFrame:
    """`docs` with its owned secrets blanked: each span's code points become `*`; examples and placeholders stay.

    All rows and columns stay, null and empty texts too; columns of any name pass through. Only texts in which a pattern matches are moved;
    the others pass through a narrow filter.
    """
    text_col = options.get("text_col", "text")
    row, spans = fresh(docs, "row"), fresh(docs, "spans")
    hit = suspicious(F.col(text_col))
    # the numbers of the rows hold from here on, whatever is computed again
    flagged = checkpointed(docs.where(hit).withColumn(row, F.monotonically_increasing_id()))
    found = scan(flagged, row_col=row, **options).select(F.col("row").alias(row), F.filter("secrets", lambda x: x["verdict"] == "owned").alias(spans))
    return docs.where(~hit).unionByName(_blank(flagged.join(found, row), text_col, spans).drop(row, spans))


def _blank(df: DataFrame, text_col: str, spans: str) -> DataFrame:
    ends = F.concat(F.transform(F.col(spans), lambda x: x["start"]), F.array(F.length(text_col).cast("long")))
    pieces = F.transform(
        F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.col(spans), lambda x: x["end"])).alias("a"), ends.alias("b")),
        lambda x: F.substring(F.col(text_col), (x["a"] + 1).cast("int"), F.greatest(x["b"] - x["a"], F.lit(0)).cast("int")),
    )
    stars = F.concat(F.transform(F.col(spans), lambda x: F.repeat(F.lit("*"), (x["end"] - x["start"]).cast("int"))), F.array(F.lit("")))
    whole = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), stars.alias("s")), lambda x: F.concat(x["p"], x["s"])), "")
    return df.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(F.col(text_col)))
