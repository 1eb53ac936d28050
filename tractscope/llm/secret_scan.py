"""Secret scan with corpus-wide ownership frequency (native: SQL functions only).

1. Every whole text is scanned by the base detectors (assignment, access id,
   hex run) and by one pattern of provider formats.  A candidate is a matched
   value, known afterwards only by its hash.
2. Over the corpus, each candidate hash is counted by the distinct owners and
   the distinct repositories it occurs in.  A value held by many owners, or
   by many repositories of few owners, is a copied example; of the others,
   one that some match makes a secret is *live*: as the value of an
   assignment, access id or provider format, unless it is a placeholder; as a
   bare hex run, if it looks random too.
3. Live candidates come back to their documents as spans of kind ``live``
   (the value itself); provider-format matches that are live also as
   ``provider``.  Base spans stay whatever the verdict.

Defined cases: a null text has no spans; a null owner or repository counts as
one nameless owner or repository; equal rows get equal results, each its own
row; an empty table gives an empty result; columns beside the named ones are
carried by :func:`redact_live` and ignored otherwise, whatever their names;
very long texts and texts of many matches are scanned whole.  ``documents`` has
no repository column, so a document is its own repository there and exact
copies of one count as many.

Scale: the text is read once, what it yields (hashes and offsets) is saved;
distinct counts are partial before each shuffle; a hash that a third of all
rows hold is dropped by its owner or repository count before the join, and
other skew is left to the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded_before, regex_spans, saved, spans_text

# The base detectors.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
# Public provider formats; placeholder words of documentation.
PROVIDER = (r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
            r"|sk_live_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9]{20,}+|AIza[A-Za-z0-9_-]{35}"
            r"|(?<!-)eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)")
PROVIDER_GATE = r"gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-[A-Za-z0-9]{20}|AIza|eyJ"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0{8}|12345678|abcdef01|^(.)\1*$"

KINDS = ("assign", "access", "hex", "provider", "live")
MAX_LIVE_OWNERS = 2      # distinct owners up to which a value is owner-specific
MAX_LIVE_REPOS = 50      # distinct repositories up to which it is, whoever owns them
MIN_LIVE_DISTINCT = 8    # different characters a bare hex run needs


def _spans(text: Column, kind: str, pattern: str, gate: Column, value_group: int = 0, min_value: int = 0) -> Column:
    """Spans of one kind: (start, ord, end, kind, value)."""
    groups = (0,) if value_group == 0 else (0, value_group)
    found = regex_spans(text, pattern, gate, groups)
    if min_value:
        found = F.filter(found, lambda s: F.length(s[f"g{value_group}"]) >= min_value)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"),
        F.lit(kind).alias("kind"), s[f"g{value_group}"].alias("value")))


def _looks_live(v: Column, kind: Column) -> Column:
    """No placeholder; a bare hex run also needs letters, digits and many different characters."""
    random = v.rlike("[a-f]") & v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_LIVE_DISTINCT)
    return ~v.rlike(PLACEHOLDER) & ((kind != "hex") | random)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id") -> DataFrame:
    """One row per document: (id, th, owner, repo, base, cand).

    ``base`` are the base spans by start then kind; ``cand`` the candidates
    with their value hash and whether this match makes the value a secret."""
    text = F.col(text_col)
    spans = F.concat(
        _spans(text, "assign", ASSIGN, text.rlike(ASSIGN_GATE), 2, 12),
        _spans(text, "access", ACCESS, text.contains("AKIA")),
        _spans(text, "hex", HEX, text.rlike("[0-9a-f]{16}")),
        _spans(text, "provider", PROVIDER, text.rlike(PROVIDER_GATE)))
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner"),
        F.col(repo_col).alias("repo"), F.array_sort(spans).alias("spans"))
    cand = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
        (s["end"] - F.length(s["value"])).alias("value_start"), F.sha2(s["value"], 256).alias("vh"),
        _looks_live(s["value"], s["kind"]).alias("likely")))
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "provider"), lambda s: F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    return saved(found.select("id", "th", "owner", "repo", base.alias("base"), cand.alias("cand")))


def ownership(scanned: DataFrame) -> DataFrame:
    """Each candidate hash with its distinct owners and repositories and the verdict."""
    each = scanned.where(F.size("cand") > 0).select("owner", "repo", F.explode("cand").alias("c"))
    each = each.select("owner", F.struct("repo").alias("repo"), F.col("c.vh").alias("vh"), F.col("c.likely").alias("likely"))
    freq = each.groupBy("vh").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"),
                                  F.max("likely").alias("likely"))
    copied = (F.col("n_owners") > MAX_LIVE_OWNERS) | (F.col("n_repos") > MAX_LIVE_REPOS)
    verdict = (F.when(copied, "copied").when(F.col("likely"), "live").otherwise("weak"))
    return freq.select("vh", "n_owners", "n_repos", verdict.alias("verdict"))


def live_spans(scanned: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(id, th, live, n_repos): the live spans of every document that has any,
    and the most repositories that hold one of its live values.  ``owners``:
    verdicts of :func:`ownership` over a larger corpus than ``scanned``."""
    each = scanned.where(F.size("cand") > 0).select("id", "th", F.explode("cand").alias("c"))
    live = (ownership(scanned) if owners is None else owners).where("verdict = 'live'").select("vh", "n_repos")
    value = F.struct(F.col("c.value_start").alias("start"), F.lit(KINDS.index("live")).alias("ord"),
                     F.col("c.end").alias("end"), F.lit("live").alias("kind"))
    whole = F.struct(F.col("c.start").alias("start"), F.lit(KINDS.index("provider")).alias("ord"),
                     F.col("c.end").alias("end"), F.lit("provider").alias("kind"))
    both = F.when(F.col("c.kind") == "provider", F.array(value, whole)).otherwise(F.array(value))
    marked = each.join(live, F.col("c.vh") == live["vh"]).select("id", "th", "n_repos", F.explode(both).alias("s"))
    return marked.groupBy("id", "th").agg(F.array_sort(F.collect_set("s")).alias("live"), F.max("n_repos").alias("n_repos"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base
    spans, all spans, how many live ones, and the most repositories that hold
    one of the live values (0 without any)."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    live = live_spans(scanned).withColumnsRenamed({"id": "l_id", "th": "l_th"})
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = scanned.join(live, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("th") == F.col("l_th")), "left")
    added = F.coalesce("live", F.filter("base", lambda s: F.lit(False)))
    return out.select(
        F.col("id").alias(id_col), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(F.filter(added, lambda s: s["kind"] == "live")).cast("long").alias("n_live"),
        F.coalesce("n_repos", F.lit(0)).cast("long").alias("n_repos"))


MASK = "[SECRET]"
MAX_BROADCAST_SPANS = 250_000    # live spans up to which they go to every task (about 20 MB)


def _masked(text: Column, spans: Column) -> tuple[Column, Column]:
    """(column ``__wide`` to add first, ``text`` with every span replaced by
    ``MASK``): spans in order, one inside
    an earlier one adds nothing, one that begins inside an earlier one prolongs
    its mask.  Pieces are cut from four bytes a character, which finds a place
    at once, so many spans in a long text cost no square of their number."""
    wide = F.encode(text, "UTF-32")

    def cut(start: Column, end: Column) -> Column:  # a mark of order first, so that one in the text stays
        return F.decode(F.concat(F.lit(bytes.fromhex("0000feff")), F.substring(F.col("__wide"), 4 * start + 1, 4 * (end - start))), "UTF-32")

    reach = folded_before(F.transform(spans, lambda s: s["end"]), F.greatest)
    pieces = F.transform(F.arrays_zip(spans.alias("s"), reach.alias("at")), lambda z: F.when(
        z["s"]["start"] >= z["at"], F.concat(cut(z["at"], z["s"]["start"]), F.lit(MASK))).otherwise(F.lit("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return wide, F.concat(F.array_join(pieces, ""), cut(last, F.length(text)))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                repo_col: str = "doc_id", chars_col: str = "n_chars", corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with every live value replaced by ``MASK``; all rows and columns
    stay, copied examples too.  ``chars_col``, where present, follows a masked text.

    ``corpus`` is a table whose owners and repositories count beside those of
    ``docs``; where ``docs`` is what a filter left of a corpus, a value that
    many owners hold in the corpus is a copied example though one is left.

    The live spans, known by id and text hash, are counted: up to
    ``MAX_BROADCAST_SPANS`` they are broadcast and ``docs`` is read once more
    and not moved; beyond, documents that may hold a candidate are joined by
    shuffle and the others pass by."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    # distinct owners and repositories: rows that both tables hold count once
    owners = None if corpus is None else ownership(scanned.unionByName(scan(corpus, id_col, text_col, owner_col, repo_col)))
    live = saved(live_spans(scanned, owners).select(F.col("id").alias("__l_id"), F.col("th").alias("__l_th"), F.col("live").alias("__live")))
    text = F.col(text_col)
    same = F.col(id_col).eqNullSafe(F.col("__l_id")) & (F.xxhash64(text) == F.col("__l_th"))
    n_spans = live.agg(F.sum(F.size("__live"))).first()[0] or 0
    if n_spans <= MAX_BROADCAST_SPANS:
        rest, joined = None, docs.join(F.broadcast(live), same, "left")
    else:
        may = F.coalesce(text.rlike(ASSIGN_GATE) | text.contains("AKIA") | text.rlike("[0-9a-f]{16}")
                         | text.rlike(PROVIDER_GATE), F.lit(False))
        rest, joined = docs.where(~may), docs.where(may).join(live, same, "left")
    wide, cut = _masked(text, F.col("__live"))
    hit = F.col("__live").isNotNull()
    done = joined.withColumn("__wide", F.when(hit, wide)).withColumn(text_col, F.when(hit, cut).otherwise(text))
    if chars_col in docs.columns:
        done = done.withColumn(chars_col, F.when(hit, F.length(text_col).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    done = done.select(*[F.col(f"`{c}`") for c in docs.columns])
    return done if rest is None else rest.unionByName(done)
