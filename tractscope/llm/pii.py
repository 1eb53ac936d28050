"""Personal data by weak supervision (native: SQL functions only).

Candidate spans come from regular expressions: the base kinds (email, ip,
card, phone), which stay as they are, and looser ones (a phone number without
a plus sign, a national id, a bank account, a titled name).  Labelers vote on
every candidate: +1 personal, -1 not, 0 abstain.

* ``form``     - the shape of the match itself (regex),
* ``list``     - gazetteers: mail domains, calling codes, issuer digits, names,
* ``before``   - words in front of the match,
* ``after``    - what follows it,
* ``edge``     - whether it is cut out of a longer token.

Expectation-maximisation over the counts of the vote patterns estimates how
reliable each labeler is and how common personal spans are per kind.  Its
posteriors are the soft labels of the final span classifier, a logistic
regression over kind, votes, length class, the span's shape and the words
around it (hashed), trained on a bounded sample of candidates and applied to
all of them: what votes know of some spans is carried to others like them.
Candidates of the looser kinds with a probability of ``THRESHOLD`` or more
are added to the base spans.

The driver sees pattern counts, at most ``len(KINDS) * 3**5 * 4`` rows however
large the corpus, and the features of at most ``SAMPLE`` candidates.  The texts are read once; spans and votes are saved
and scored where they lie, without a join.

Defined cases: null text has no span; very long texts and texts of many matches
are scanned whole; equal rows give equal results; empty
tables give no row (the classifier then keeps its prior); other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import regex_spans, saved, spans_text

# The base detectors.  Possessive forms and the look-behind
# match the same spans as the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The looser kinds.
LOCAL_PHONE = r"(?<![0-9+().-])(?:\([0-9]{2,4}\)|[0-9]{3,4})[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-]|\.[0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "account", "name")
BASE = KINDS[:4]
LABELERS = ("form", "list", "before", "after", "edge")
THRESHOLD = 0.5
EM_ROUNDS, FIT_ROUNDS = 50, 300

# Gazetteers and context words.
CONTEXT = (r"(?i)(?:mail|contact|kontakt|correo|courriel|tel|phone|call|fax|mobile|anruf|card|visa|karte|carte|tarjeta"
           r"|ssn|social|iban|account|konto|compte|cuenta|address|adresse|host|server|ip|name|from|user)\W{0,6}(?:\w+\W{1,3}){0,2}$")
COUNTER = r"(?i)(?:version|ver|release|section|figure|table|page|isbn|order|invoice|v)\W{0,4}$"
MAIL_TLD = (r"(?i)\.(?:com|org|net|edu|gov|mil|int|io|info|biz|name|pro|dev|app|me|tv|cc|eu|de|at|ch|fr|be|lu|es|pt|it|nl|uk|ie|dk|se|no|fi|is|pl|cz|sk"
            r"|hu|ro|bg|gr|tr|ru|ua|ee|lv|lt|si|hr|rs|il|ae|sa|in|pk|cn|hk|tw|jp|kr|sg|my|th|vn|id|ph|au|nz|ca|us|mx|br|ar|cl|co|pe|ve|uy|za|ng|ke|eg|ma)$")
PLACEHOLDER = r"(?i)(?:^|[@.])(?:noreply|example|test|localhost)(?:$|@)|^(?:0\.0\.0\.0|127\.0\.0\.1|255\.255\.255\.255)$"
NAMES = (r"(?i)\x20(?:anna|maria|john|james|mary|peter|paul|thomas|michael|david|jean|marie|carlos|jose|laura|sarah|robert|william|richard|joseph"
         r"|charles|christopher|daniel|matthew|anthony|mark|donald|steven|andrew|joshua|kenneth|kevin|brian|george|timothy|ronald|edward|jason|jeffrey"
         r"|ryan|jacob|gary|nicholas|eric|jonathan|stephen|patricia|jennifer|linda|elizabeth|barbara|susan|jessica|karen|lisa|nancy|betty|margaret"
         r"|sandra|ashley|kimberly|emily|donna|michelle|carol|amanda|melissa|deborah|stephanie|rebecca|sharon|cynthia|kathleen|amy|angela|hans|klaus"
         r"|jürgen|wolfgang|dieter|uwe|stefan|andreas|martin|christian|markus|sabine|petra|monika|ursula|renate|ingrid|heike|birgit|katrin|julia|pierre"
         r"|michel|philippe|alain|nicolas|christophe|laurent|françois|julien|antoine|isabelle|nathalie|sylvie|catherine|sophie|céline|juan|antonio"
         r"|manuel|francisco|luis|javier|miguel|ángel|pedro|alejandro|carmen|ana|isabel|dolores|pilar|teresa|rosa|lucía|elena|marta|cristina)\b")
# The zones of international calling codes.
CALLING = (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
           r"|(?:2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9])")

# Features of a span beside the votes: its shape and the words around it, hashed.
BUCKETS = 64
SAMPLE_PER_KIND = 4000   # candidates of a kind the classifier is trained on, about
SAMPLE = 40_000          # and at most in all
EXTRA = ("shape", "word_before", "word_after")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def _votes(kind: str, s: Column) -> dict[str, Column]:
    v = s["g0"]
    d = _digits(v)
    form = {
        "email": _vote(v.rlike(r"^[A-Za-z0-9].{1,63}@[A-Za-z0-9].*\.[A-Za-z]{2,24}$"), v.rlike(r"\.[0-9]+$")),
        "ip": _vote(~v.rlike(r"(?:^|\.)0[0-9]"), v.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(F.length(d).isin(15, 16), F.length(d) > 16),
        "phone": _vote(F.length(d).between(10, 13), F.length(d) > 13),
        "local_phone": _vote(F.length(d).between(9, 11), F.length(d) < 9),
        "national_id": _vote(~v.rlike("^(?:000|666|9)|-00-|-0000$"), v.rlike("^(?:000|666|9)|-00-|-0000$")),
        "account": _vote(F.length(F.regexp_replace(v, " ", "")).between(15, 34), F.length(v) < 15),
        "name": _vote(v.rlike(r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$")),
    }[kind]
    gazetteer = {
        "email": _vote(v.rlike(MAIL_TLD), v.rlike(PLACEHOLDER)),
        "ip": _vote(~v.rlike(r"^(?:0|10|127|255)\.|^192\.168\."), v.rlike(PLACEHOLDER)),
        "card": _vote(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), d.rlike("^[01789]")),
        "phone": _vote(v.rlike(CALLING), v.rlike(r"^\+0")),
        "local_phone": _vote(v.rlike(r"^\(?(?:0[1-9]|[2-9][0-9]{2})"), v.rlike("555.0[01]")),
        "national_id": F.lit(0),
        "account": _vote(v.rlike("^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|PT|PL)"), v.rlike("^(?:XX|AA|ZZ)")),
        "name": _vote(v.rlike(NAMES)),
    }[kind]
    return {
        "form": form,
        "list": gazetteer,
        "before": _vote(s["before"].rlike(CONTEXT), s["before"].rlike(COUNTER)),
        "after": _vote((s["after"] == "") | s["after"].rlike(r"^[\s.,;:!?)\]>\"']"), s["after"].rlike(r"^[\p{L}\p{N}_=/@]")),
        "edge": _vote((s["before"] == "") | s["before"].rlike(r"[\s(\[<\"':;,]$"), s["before"].rlike(r"[\p{L}\p{N}_=/@.]$")),
    }


def _bucket(text: Column) -> Column:
    """0 for an empty text, else one of ``BUCKETS`` - 1 by hash."""
    return F.when(text == "", F.lit(0)).otherwise(F.pmod(F.xxhash64(text), F.lit(BUCKETS - 1)).cast("int") + 1)


def _extra(s: Column) -> dict[str, Column]:
    """The span's character classes without repeats (``Aa 9-9``), and the nearest words on either side."""
    classes = s["g0"]
    for pattern, sign in ((r"\p{Ll}", "a"), (r"\p{Lu}", "A"), ("[0-9]", "9"), (r"(.)\1+", "$1")):
        classes = F.regexp_replace(classes, pattern, sign)
    return {"shape": _bucket(F.left(classes, F.lit(12))),
            "word_before": _bucket(F.lower(F.regexp_extract(s["before"], r"(\p{L}+)\P{L}*$", 1))),
            "word_after": _bucket(F.lower(F.regexp_extract(s["after"], r"^\P{L}*(\p{L}+)", 1)))}


def _voted(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        *[v.cast("int").alias(n) for n, v in _votes(kind, s).items()],
        F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(3)).cast("int").alias("len"),
        *[c.alias(n) for n, c in _extra(s).items()]))


def _candidates(text: Column) -> Column:
    """All candidates of a text: (start, ord, end, kind, votes...), by start then kind."""
    digit14 = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    plan = {
        "email": (EMAIL, text.contains("@"), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]{1,}+\.[0-9]{1,}+\.[0-9]"), lambda s: s["g0"].rlike(IP_OK)),
        "card": (CARD, digit14, lambda s: F.length(_digits(s["g0"])).between(14, 19) & _luhn(_digits(s["g0"]))),
        "phone": (PHONE, text.rlike(r"\+[0-9]"), lambda s: F.length(_digits(s["g0"])).between(10, 15)),
        "local_phone": (LOCAL_PHONE, text.rlike(r"[0-9]\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3}"), None),
        "national_id": (NATIONAL_ID, text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), None),
        "account": (ACCOUNT, text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), None),
        "name": (NAME, text.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señora?)\.?\x20\p{Lu}"), None),
    }
    found = []
    for kind, (pattern, gate, ok) in plan.items():
        spans = regex_spans(text, pattern, gate, context=40)
        spans = spans if ok is None else F.filter(spans, ok)
        found.append(_voted(spans, kind))
    return F.array_sort(F.concat(*found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cand): every candidate of every document with its votes, saved."""
    return saved(docs.select(F.col(id_col).alias("id"), _candidates(F.col(text_col)).alias("cand")))


def vote_patterns(scanned: DataFrame) -> list[tuple]:
    """(kind, votes..., len, count): bounded by the vote space, not the corpus."""
    each = scanned.where(F.size("cand") > 0).select(F.explode("cand").alias("c"))
    keys = ["kind", *LABELERS, "len"]
    return [tuple(r) for r in each.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.count("*")).collect()]


def reliabilities(patterns: list[tuple]) -> tuple[dict, dict, dict]:
    """EM for two classes: prior per kind, P(vote | class) per labeler, posterior per pattern.

    Started from the votes' own balance; votes are smoothed by one count."""
    prior = {k: 0.7 for k in KINDS}
    likely = {(j, c, v): (0.7 if v == (1 if c else -1) else 0.15) for j in LABELERS for c in (0, 1) for v in (-1, 0, 1)}
    post: dict[tuple, float] = {}
    for _ in range(EM_ROUNDS):
        for *key, _n in sorted(patterns):
            kind, votes = key[0], key[1:1 + len(LABELERS)]
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in zip(LABELERS, votes):
                a, b = a + math.log(likely[j, 1, v]), b + math.log(likely[j, 0, v])
            post[tuple(key)] = 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))
        for k in KINDS:
            mine = [(post[tuple(p[:-1])], p[-1]) for p in patterns if p[0] == k]
            prior[k] = (sum(q * n for q, n in mine) + 7) / (sum(n for _, n in mine) + 10)
        for i, j in enumerate(LABELERS):
            for c in (0, 1):
                total = {v: 1.0 + (2.0 if v == (1 if c else -1) else 0.0) for v in (-1, 0, 1)}
                for p in patterns:
                    q = post[tuple(p[:-1])]
                    total[p[1 + i]] += (q if c else 1 - q) * p[-1]
                for v in total:
                    likely[j, c, v] = total[v] / sum(total.values())
    return prior, likely, post


def examples(scanned: DataFrame, patterns: list[tuple]) -> list[tuple]:
    """(kind, votes..., len, shape, words around, 1) of the candidates the
    classifier is trained on: those of least hash, about ``SAMPLE_PER_KIND`` of
    each kind and at most ``SAMPLE``."""
    held = {k: sum(p[-1] for p in patterns if p[0] == k) for k in KINDS}
    share = F.coalesce(*[F.when(F.col("c.kind") == k, F.lit(min(1.0, SAMPLE_PER_KIND / n))) for k, n in held.items() if n], F.lit(0.0))
    each = scanned.where(F.size("cand") > 0).select("id", F.explode("cand").alias("c"))
    place = F.xxhash64("id", "c.start", "c.ord")
    picked = each.withColumn("place", place).where(F.pmod("place", F.lit(1 << 20)) < share * (1 << 20))
    names = ["kind", *LABELERS, "len", *EXTRA]
    rows = picked.orderBy("place", *[f"c.{n}" for n in names]).limit(SAMPLE).select(*[f"c.{n}" for n in names])
    return [(*r, 1) for r in rows.collect()]


def _features(row: tuple) -> list[tuple]:
    """Of (kind, votes..., len, shape and words where known)."""
    kind, votes, length, extra = row[0], row[1:1 + len(LABELERS)], row[1 + len(LABELERS)], row[2 + len(LABELERS):]
    return [("bias",), ("kind", kind), ("len", length), *[(j, v) for j, v in zip(LABELERS, votes) if v], *zip(EXTRA, extra)]


def train(rows: list[tuple], post: dict[tuple, float]) -> dict[tuple, float]:
    """Logistic regression on the soft labels of ``rows`` (vote patterns with
    their counts, or :func:`examples`), weighted by the square root of the
    count; gradient descent with a small ridge."""
    width = 2 + len(LABELERS)
    data = [(_features(r[:-1]), post[r[:width]], math.sqrt(r[-1])) for r in sorted(rows)]
    names = sorted({f for fs, _, _ in data for f in fs} | {("bias",)}, key=str)
    place = {f: i for i, f in enumerate(names)}
    at = np.array([place[f] for fs, _, _ in data for f in fs], dtype=np.int64)
    of = np.array([i for i, (fs, _, _) in enumerate(data) for _ in fs], dtype=np.int64)
    label, weight = np.array([q for _, q, _ in data]), np.array([w for _, _, w in data])
    weights, total = np.zeros(len(names)), weight.sum() or 1.0
    for _ in range(FIT_ROUNDS if data else 0):
        z = np.bincount(of, weights[at], minlength=len(data))
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label) * weight / total
        weights -= 2.0 * (np.bincount(at, e[of], minlength=len(names)) + 1e-3 * weights)
    return {f: float(weights[i]) for f, i in place.items()}


def _probability(s: Column, weights: dict[tuple, float]) -> Column:
    """The classifier as one SQL expression."""
    z = F.lit(weights.get(("bias",), 0.0))
    for field, of in (("kind", KINDS), ("len", (0, 1, 2, 3)), *[(j, (-1, 1)) for j in LABELERS]):
        case = F.lit(0.0)
        for v in of:
            case = F.when(s[field] == v, F.lit(weights.get((field, v), 0.0))).otherwise(case)
        z = z + case
    for field in EXTRA:
        z = z + F.element_at(F.array(*[F.lit(weights.get((field, v), 0.0)) for v in range(BUCKETS)]), s[field] + 1)
    return 1 / (1 + F.exp(-z))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base
    spans, all spans by start then kind, how many were added, and how many
    base spans the classifier doubts."""
    scanned = scan(docs, id_col, text_col)
    patterns = vote_patterns(scanned)
    _, _, post = reliabilities(patterns)
    weights = train(examples(scanned, patterns), post)
    base = F.filter("cand", lambda s: s["kind"].isin(*BASE))
    kept = F.filter("cand", lambda s: s["kind"].isin(*BASE) | (_probability(s, weights) >= THRESHOLD))
    doubt = F.filter(base, lambda s: _probability(s, weights) < THRESHOLD)
    n = lambda k: F.size(F.filter("cand", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("id").alias(id_col), *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(kept).alias("spans"),
        (F.size(kept) - F.size(base)).cast("long").alias("n_added"), F.size(doubt).cast("long").alias("n_doubted"))
