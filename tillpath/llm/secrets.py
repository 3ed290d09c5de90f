"""Secret scans with corpus-wide ownership frequency.

Base patterns (assignments, access keys, hex runs) are found in every text with their places.
Further patterns take opaque tokens as candidates, each as a whole:

- keys with a known prefix (`PREFIXED`), in the alphabet of that prefix;
- tokens of 20 characters or more of letters, digits, `_`, `+` and `-` with a digit and letters of
  both cases (`TOKEN`);
- tokens that may also hold `/` and `.` inside and end in `=` padding (`WIDE`), which have a digit
  and pass a test of randomness: the places where a small letter, a capital or a digit is followed
  by one of another of these classes. Words have few of them; of random neighbours over letters and
  digits 62 % differ, over small letters and digits 40 %. Needed is one place for every four
  characters with letters of both cases, for every six with letters of one case. An `=` inside
  divides a name from its value and is no part of a token.

A candidate that lies inside a longer one is part of it. The value of every finding is hashed, and
hashes are counted over the corpus by distinct documents (the repositories here) and distinct
sources (the owners). A value that several owners show, or very many documents of few owners, is a
copied example; any other that is a candidate is a credential. Candidates of the second kind are added as spans of
kind `live` unless a base span covers them; base spans always stay.

Places come from two regular-expression functions alone: the matches, and the pieces between them,
whose lengths add up to the offsets. Nothing leaves the JVM. Counts are aggregated in steps
(value, owner or document), then value, each combined before its shuffle, so a value that a third of
the corpus holds is one row per task.

Edge cases: NULL and empty texts have no spans; the digest of no spans is that of the empty string.
Every row of the input gives a row, repeated doc_ids too (a repeated document counts once towards
the frequency, and so do all rows without doc_id). A NULL source is an owner of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import attach, text_of
from tillpath.session import stage

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
# The order of kinds at one start.
KINDS = ("assign", "access", "hex", "live")

# Candidates of the method, see above. The conditions are part of the pattern, so that ordinary long words are no matches.
TOKEN = (
    r"(?<![A-Za-z0-9_+-])(?=[A-Za-z_+-]*+[0-9])(?=[A-Z0-9_+-]*+[a-z])(?=[a-z0-9_+-]*+[A-Z])"
    r"[A-Za-z0-9_+-]{20,}"
)
# The alphabet is the class in front of each count; a longer run of it is taken to its end.
PREFIXED = (
    r"(?<![A-Za-z0-9])(?:[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|gh[opsur]_[A-Za-z0-9]{20,}"
    r"|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{15,}|AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|sk-(?:ant|proj)-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9]{20,}"
    r"|pypi-[A-Za-z0-9_-]{30,}|dop_v1_[0-9a-f]{32,}|shp(?:at|ca|pa|ss)_[0-9A-Fa-f]{24,}"
    r"|dckr_pat_[A-Za-z0-9_-]{20,}|ASIA[A-Z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
# Dots before and after a token are none of it. It begins where no token goes on, so that a run is
# looked at once; the digit is part of the pattern, the test of randomness follows.
WIDE = (
    r"(?<![A-Za-z0-9+/_-])(?<![A-Za-z0-9+/_-]\.{1,9})(?=[A-Za-z+/_.-]*+[0-9])"
    r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{18,}[A-Za-z0-9+/_-]={0,2}"
)
# Every candidate holds such a run.
_LONG = r"[A-Za-z0-9+/_.-]{20}"
_CHANGE = r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
# Characters for each change of class, with letters of both cases and of one.
BOTH_CASES_EVERY, ONE_CASE_EVERY = 4, 6
# From this many owners on, or from this many documents on, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_DOCUMENTS = 3, 10

_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def _spans(text: str, pattern: str, rank: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans; `value` is the wanted group.

    Match i begins after the pieces 0..i and the matches before it.
    """
    found = F.regexp_extract_all(text, _literal(pattern), F.lit(0))
    values = F.regexp_extract_all(text, _literal(pattern), F.lit(value_group))
    parts = F.arrays_zip(
        F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)).alias("gap"),
        found.alias("hit"),
        values.alias("value"),
    )
    empty = F.expr(f"struct(cast(array() as {_SPAN}) as spans, 0 as at)")
    walked = F.aggregate(
        parts,
        empty,
        lambda s, p: F.struct(
            F.concat(
                s["spans"],
                F.array(
                    F.struct(
                        (s["at"] + F.char_length(p["gap"])).alias("start"),
                        F.lit(rank).alias("rank"),
                        (s["at"] + F.char_length(p["gap"]) + F.char_length(p["hit"])).alias("end"),
                        p["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
            (s["at"] + F.char_length(p["gap"]) + F.char_length(p["hit"])).alias("at"),
        ),
    )
    return walked["spans"]


def _random(value: Column) -> Column:
    changes = F.regexp_count(value, _literal(_CHANGE))
    both = value.rlike("[a-z]") & value.rlike("[A-Z]")
    return changes * F.when(both, BOTH_CASES_EVERY).otherwise(ONE_CASE_EVERY) >= F.char_length(value)


def _candidates() -> Column:
    """The candidates of the column `_text`, also those inside a longer one."""
    wide = F.filter(_spans("_text", WIDE, 3), lambda s: _random(s["value"]))
    return F.array_distinct(F.concat(_spans("_text", PREFIXED, 3), _spans("_text", TOKEN, 3), wide))


def _covers(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def findings(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row: a number `_row`, doc_id, source, the spans of each base pattern and the candidate tokens; with
    `whole` the row itself as the struct `doc`, where its columns clash with none of these."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    texts = docs.select(
        "doc_id",
        F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source"),
        F.monotonically_increasing_id().alias("_row"),
        text_of().alias("_text"),
        *carried,
    )
    low = F.lower("_text")
    # Plain substring tests spare most texts the costly pattern; each is implied by it.
    worded = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret"))
    worded = worded | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    assign = F.filter(
        _spans("_text", ASSIGN, 0, 2), lambda s: F.char_length(s["value"]) >= ASSIGN_VALUE
    )
    access = F.filter(_spans("_text", ACCESS, 1), lambda s: s["end"] - s["start"] >= ACCESS_CHARS)
    runs = F.filter(_spans("_text", HEX, 2), lambda s: s["end"] - s["start"] >= HEX_CHARS)
    return texts.select(
        "_row", "doc_id", "source", *(["doc"] if whole else []),
        F.when(worded, assign).otherwise(_none()).alias("assign"),
        F.when(F.contains("_text", F.lit("AKIA")), access).otherwise(_none()).alias("access"),
        F.when(F.col("_text").rlike(f"[0-9a-f]{{{HEX_CHARS}}}"), runs).otherwise(_none()).alias("hex"),
        F.when(F.col("_text").rlike(_LONG), _candidates()).otherwise(_none()).alias("tokens"),
    )


def _apart(found: DataFrame) -> DataFrame:
    """Adds `base`, all base spans, and leaves the tokens that neither one of them nor a longer token covers."""
    return found.withColumn("base", F.concat("assign", "access", "hex")).withColumn(
        "tokens",
        F.filter(
            "tokens",
            lambda t: ~F.exists("base", lambda b: _covers(b, t))
            & ~F.exists("tokens", lambda o: (o != t) & _covers(o, t)),
        ),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash over the corpus: n_documents and n_owners that hold it."""
    values = found.where(F.size("base") + F.size("tokens") > 0).select(
        "doc_id", "source", F.explode(F.concat("base", "tokens")).alias("s")
    ).select(F.sha2("s.value", 256).alias("value_hash"), "source", "doc_id")
    # Structs, as NULL is an owner and a document too.
    return values.groupBy("value_hash").agg(
        F.count_distinct(F.struct("doc_id")).alias("n_documents"),
        F.count_distinct(F.struct("source")).alias("n_owners"),
        F.count(F.lit(1)).alias("n_findings"),
    )


def scan(
    docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_documents: int = EXAMPLE_DOCUMENTS
) -> DataFrame:
    """Per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, verdicts.

    `n_live` counts the added spans, `n_example` the findings whose value at least
    `example_owners` owners or `example_documents` documents show. `verdicts` tells for every finding, base ones and
    candidates, `kind:start:end:owners:documents:example` or `...:own`, in the order of the spans.
    """
    return _scanned(docs, example_owners, example_documents)


def _scanned(docs: DataFrame, example_owners: int, example_documents: int, whole: bool = False) -> DataFrame:
    """The columns of `scan`; with `whole` also `doc`, the row. Only rows with findings move."""
    # Stored before anything is derived from it: each pattern runs once per text.
    found = _apart(stage(findings(docs, whole), "secret-findings"))
    holders = stage(ownership(found), "secret-owners")
    each = found.where(F.size("base") + F.size("tokens") > 0).select(
        "_row", F.explode(F.concat("base", "tokens")).alias("s")
    ).withColumn("value_hash", F.sha2("s.value", 256))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_documents") >= example_documents)
    live = (F.col("s.rank") == 3) & ~copied
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.struct(
        F.col("s.start"), F.col("s.rank"), F.col("s.end"),
        F.concat_ws(
            ":", names[F.col("s.rank")], F.col("s.start").cast("string"), F.col("s.end").cast("string"),
            F.col("n_owners").cast("string"), F.col("n_documents").cast("string"),
            F.when(copied, "example").otherwise("own"),
        ).alias("text"),
    )
    # A value that very many rows show is attached by broadcast (at most 1000 of them).
    judged = attach(each, holders, ["value_hash"], "n_findings")
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.when(live, F.col("s"))).alias("live"),
        F.count_if(copied).alias("n_example"),
        F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda v: v["text"]), ",").alias("verdicts"),
    )
    hits, misses = found.where(F.size("base") + F.size("tokens") > 0), found.where(
        F.size("base") + F.size("tokens") == 0
    )
    joined = hits.join(per_row, "_row").unionByName(
        misses.withColumn("live", _none()).withColumn("n_example", F.lit(0).cast("long")).withColumn("verdicts", F.lit(""))
    )
    return joined.select(
        "doc_id", *(["doc"] if whole else []),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "live")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_example", "verdicts",
    )


def redact(
    docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, mark: str = "[SECRET]",
    example_documents: int = EXAMPLE_DOCUMENTS,
) -> DataFrame:
    """`docs` with every span of `scan` replaced by `mark`; n_chars follows the text.

    All base spans are masked, whatever their verdict; added spans are those whose verdict is `own`. Every row goes
    with its own spans all the way, so doc_ids may be NULL or repeated, and rows without findings stay where they are.
    """
    found = _scanned(docs, example_owners, example_documents, whole=True)
    text = F.col("doc.text")
    places = F.transform(
        F.split("spans", ","),
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("b"),
        ),
    )
    walked = F.aggregate(
        places,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        # Spans are in order of their start; one that begins inside the last mark only extends it.
        lambda s, p: F.struct(
            F.when(
                (p["a"] >= s["at"]) & (p["b"] > s["at"]),
                F.concat(s["out"], F.substring(text, s["at"] + 1, p["a"] - s["at"]), F.lit(mark)),
            ).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], p["b"]).alias("at"),
        ),
    )
    tail = F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.lit(2**31 - 1)))
    masked = F.when(F.col("spans") != "", tail).otherwise(text)
    columns = []
    for name in docs.columns:
        value = F.col(f"doc.`{name}`")
        if name == "text":
            value = masked
        elif name == "n_chars":
            size = F.char_length(masked).cast(docs.schema[name].dataType)
            value = F.when(F.col("spans") != "", size).otherwise(value)
        columns.append(value.alias(name))
    return found.select(*columns)
