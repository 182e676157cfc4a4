"""PII: candidate gradient boosting over DataFrame expressions.

Base matchers (email, ip, card, phone) find spans with checks of format; these always stay. High-recall generators
propose more, overlapping candidates (a secret of any length, with its separators and apart; an account number to its last group); boosted trees over features of format and context score them; a threshold for each kind,
calibrated on held-out rows, selects redactions. Spans may overlap each other and base spans; one that lies wholly in another
adds nothing and goes. Spans are in code points, end exclusive.

The trees are fitted by the driver on at most `rows` labelled template rows (a documented bound) and become CASE expressions, so that
scoring stays in the JVM. All candidates and features come from one set of column expressions, in fitting and in scoring.

Patterns are written so that a long text costs time in proportion to its length: a run of characters that can start a match is entered
at its front only, and no group repeats without bound.

Nulls: a null text is an empty text without spans. Equal rows get equal spans. Empty table: no rows. Other columns pass unread; a
column that clashes with an added one is replaced.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?=(?:[ -]?[0-9]){11})[0-9 -]*?(?![0-9]|[ -][0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_FITS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"

#: Kinds that the method adds, each with the pattern that proposes candidates.
GENERATORS = {
    "email_hidden": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63} ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "phone_local": r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}(?: ?[A-Z0-9]{3}|(?: ?[A-Z0-9]{4}){1,5}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![0-9.,+-])[0-9]{8,11}(?![0-9.,-])",
}
#: A kind's second pattern, for candidates around those of the first: keys with + or /, = at the end, and dots between parts.
WIDER = {"secret": r"(?<![A-Za-z0-9_+/-])(?=(?:[A-Za-z0-9_+/-]|\.(?=[A-Za-z0-9_+/-])){16})[A-Za-z0-9_+/-]++(?:=++(?![A-Za-z0-9_+/-]))?+(?:\.[A-Za-z0-9_+/-]++(?:=++(?![A-Za-z0-9_+/-]))?+)*+"}
CUES = {
    "cue_phone": r"(?i)phone|call|tel\b|tel[.:]|mobile|cell|fax|whatsapp",
    "cue_secret": r"(?i)password|passwd|pwd|secret|token|api[_ ]?key|credential|AKIA|ghp_|sk[-_]|private key",
    "cue_id": r"(?i)ssn|social security|passport|licen[cs]e no|tax id|national id|insurance|identity",
    "cue_bank": r"(?i)iban|account|bank|transfer|bic|swift",
    "cue_mail": r"(?i)e-?mail|contact|write to|reach|address",
    "cue_other": r"(?i)version|page|chapter|isbn|order|invoice|build|commit|sha|hash|http|figure|table|score|year|total|room|part number",
}
BEFORE, AFTER = 32, 12


def found(text: Column, pattern: str, check=None, kind: str = "", rank: int = 0) -> Column:
    """array<struct(start, rank, end, kind, value)> of the pattern's leftmost matches that pass the check."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(F.transform(gaps, lambda g: F.length(g)), values, lambda g, v: F.struct(F.coalesce(g, F.lit(0)).alias("gap"), v.alias("v")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["v"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        good = x["v"].isNotNull() if check is None else x["v"].isNotNull() & F.coalesce(check(x["v"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    fold = F.aggregate(sized, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), fold).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Does a string of digits pass Luhn's check?"""
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, n - i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0).otherwise(False)


def _card(v: Column) -> Column:
    digits = F.regexp_replace(v, "[ -]", "")
    return F.length(digits).between(12, 19) & luhn(digits)


def _phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    checks = {"email": (EMAIL, None), "ip": (IP, lambda v: v.rlike(IP_FITS)), "card": (CARD, _card), "phone": (PHONE, _phone)}
    return {k: found(text, p, c, k, i) for i, (k, (p, c)) in enumerate(checks.items())}


def candidates(text: Column) -> Column:
    """All generators' spans, overlapping, each with the text around it."""
    ranks = {k: len(BASE_KINDS) + i for i, k in enumerate(GENERATORS)}
    lists = [found(text, p, None, k, ranks[k]) for k, p in GENERATORS.items()] + [found(text, p, lambda v: v.rlike("[+/=.]"), k, ranks[k]) for k, p in WIDER.items()]
    return F.transform(F.concat(*lists), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE))).alias("before"), F.substring(text, s["end"] + 1, AFTER).alias("after")))


def features(c: Column) -> dict[str, Column]:
    """Numbers that describe a candidate's format and context."""
    v, around = c["value"], F.concat(c["before"], F.lit(" "), c["after"])
    n = F.length(v)
    digits = F.regexp_replace(v, "[^0-9]", "")
    out = {k: c["before"].rlike(p).cast("double") for k, p in CUES.items()}
    out |= {
        "length": n.cast("double"),
        "digit_share": F.length(digits) / n,
        "upper_share": F.length(F.regexp_replace(v, "[^A-Z]", "")) / n,
        "kinds_of_characters": F.size(F.array_distinct(F.split(v, ""))) / n,
        "switches": F.regexp_count(v, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")) / n,
        "case_switches": F.regexp_count(v, F.lit("[a-z][A-Z]|[A-Z][a-z]")) / n,
        "separators": F.length(F.regexp_replace(v, "[^./+=_-]", "")) / n,
        "hexadecimal": v.rlike("^[0-9a-f-]+$").cast("double"),
        "brackets": v.rlike(r"[\[({]").cast("double"),
        "assigned": c["before"].rlike(r"[=:]\s*[\"']?$").cast("double"),
        "key_prefix": v.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk[-_]|pk[-_]|rk[-_]|xox[bp]-|AIza|glpat-|eyJ)").cast("double"),
        "in_path": around.rlike(r"[/\\][^ ]*$|^[^ ]*[/\\]").cast("double"),
        "cue_phone_near": around.rlike(CUES["cue_phone"]).cast("double"),
    }
    return out | {f"is_{k}": (c["kind"] == k).cast("double") for k in GENERATORS}




@dataclass(frozen=True)
class Model:
    """trees: (feature, cut, left, right) or a leaf; thresholds: of the raw score, by kind."""

    base: float
    trees: tuple
    thresholds: dict[str, float]
    names: tuple[str, ...]
    held_out: dict[str, float]


def _templates(rows: int, seed: int) -> list[tuple[str, int, str]]:
    """(text, is it personal, kind) rows; the span that the kind's generator finds in a row is the labelled candidate."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    of = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, up, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    base64 = low + up + "0123456789+/"
    words = lambda glue, least, most: glue.join(of(low, r.randint(2, 9)) for _ in range(r.randint(least, most)))
    grouped = lambda account: "".join(" " * (k and k % 4 == 0) + c for k, c in enumerate(account))
    filler = lambda: " ".join(of(low, r.randint(2, 8)) for _ in range(r.randint(1, 5)))
    yes = {
        "email_hidden": lambda: (r.choice(["mail me:", "contact", "write to", "", "email"]), of(low, 6) + r.choice([" [at] ", "(at)", " (at) ", "{at}"]) + of(low, 7) + r.choice([".", " [dot] ", "(dot)"]) + r.choice(["com", "org", "net"])),
        "phone_local": lambda: (r.choice(["call", "tel:", "phone", "mobile", "fax:"]), r.choice(["(%s) %s-%s", "%s-%s-%s", "%s %s %s", "%s.%s.%s"]) % (digits(3), digits(3), digits(4))),
        "national_id": lambda: (r.choice(["SSN", "social security number", "national id:", "tax id", "passport"]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "iban": lambda: (r.choice(["IBAN", "account", "bank transfer to", "iban:", ""]), r.choice([str, grouped])(r.choice([lambda: r.choice(["DE", "ES", "IT", "NO", "BE"]) + digits(2) + digits(r.randint(11, 24)), lambda: "GB" + digits(2) + of(up, 4) + digits(14), lambda: "FR" + digits(12) + of(up + "0123456789", 11) + digits(2)])())),
        "mac": lambda: (r.choice(["device address", "mac", "host", ""]), r.choice(":-").join(of(hexa, 2) for _ in range(6))),
        "secret": lambda: r.choice([("", "AKIA" + of(up + "0123456789", 16)), ("password=", of(hexa, r.randint(16, 24))), ("token = \"", of(hexa, 40)), ("api_key:", of(low + up + "0123456789", 32)), ("", "ghp_" + of(low + up + "0123456789", 36)), ("secret:", "sk-" + of(low + up + "0123456789", 32)), ("api_key=", of(low + up + "0123456789_-", r.randint(64, 400))), ("secret key =", of(base64, 40)), ("secret=", of(base64, r.randint(20, 200)) + "=" * r.randint(0, 2)), ("token:", "eyJ" + ".".join(of(low + up + "0123456789_-", r.randint(16, 80)) for _ in range(3))), ("password:", of(base64, r.randint(16, 30)))]),
        "number": lambda: (r.choice(["tel:", "phone", "passport", "insurance", "SSN", "mobile"]), digits(r.randint(8, 11))),
    }
    no = {
        "email_hidden": lambda: ("meet", of(low, 5) + " at " + of(low, 6) + r.choice([". ", "."]) + of(low, 4)),
        "phone_local": lambda: (r.choice(["page", "figure", "score", "total", "version", "", "table"]), r.choice(["%s %s %s", "%s-%s-%s", "%s.%s.%s"]) % (digits(r.randint(2, 5)), digits(r.randint(3, 4)), digits(r.randint(3, 4)))),
        "national_id": lambda: (r.choice(["part number", "isbn", "build", "order"]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "iban": lambda: (r.choice(["commit", "part number", "hash"]), of(up, 2) + digits(2) + "".join(of(up, 4) for _ in range(r.randint(3, 5))) + of(up, r.randint(0, 3))),
        "mac": lambda: (r.choice(["hash", "commit", "version"]), "-".join(digits(2) for _ in range(6))),
        "secret": lambda: r.choice([("", of(low, r.randint(16, 40))), ("commit", of(hexa, 40)), ("", "-".join(of(low, r.randint(3, 9)) for _ in range(4))), ("http://x/", of(low, 8) + "-" + of(low, 9)), ("", "_".join(of(low, 5) for _ in range(4))), ("sha", of(hexa, 32)), ("", of(up, 1) + of(low, r.randint(16, 30))), ("", digits(20)), ("", "-" * r.randint(16, 40)), ("http:", "//www." + of(low, 8) + ".com/" + words("/", 1, 4) + r.choice(["", ".html", "/" + digits(6)])), ("", "/" + words("/", 3, 6) + r.choice(["", ".py", ".txt"])), ("", words(".", 3, 6)), ("", words("/", 3, 6)), ("", f"{digits(4)}-{digits(2)}-{digits(2)}/{digits(4)}-{digits(2)}-{digits(2)}"), ("version", ".".join(digits(r.randint(1, 3)) for _ in range(8))), ("", words("+", 3, 6)), ("", r.choice("=./_-") * r.randint(16, 60)), ("data:image/png;base64,", of(base64, r.randint(60, 400)))]),
        "number": lambda: (r.choice(["", "order", "invoice", "total", "isbn", "year", "page"]), digits(r.randint(8, 11))),
    }
    out = []
    for i in range(rows):
        kind = list(GENERATORS)[i % len(GENERATORS)]
        good = i // len(GENERATORS) % 2
        cue, value = (yes if good else no)[kind]()
        glue = "" if cue.endswith(("=", '"', "/", "http:", ",")) else " " * bool(cue)
        out.append((f"{filler()} {cue}{glue}{value} {filler()}", good, kind))
    return out


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
    """A regression tree: (feature, cut, left, right), or the leaf's value."""
    leaf = float(gradient.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-6, None, None)
    parent = gradient.sum() ** 2 / (hessian.sum() + 1)
    for f in range(x.shape[1]):
        cuts = np.unique(x[:, f])
        cuts = cuts[:: max(1, len(cuts) // 16)][1:]
        for cut in cuts:
            left = x[:, f] < cut
            gl, hl = gradient[left].sum(), hessian[left].sum()
            gain = gl**2 / (hl + 1) + (gradient.sum() - gl) ** 2 / (hessian.sum() - hl + 1) - parent
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] < best[2]
    return (best[1], best[2], _tree(x[left], gradient[left], hessian[left], depth - 1), _tree(x[~left], gradient[~left], hessian[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] < cut, _apply(left, x), _apply(right, x))


@lru_cache(maxsize=4)
def fitted(spark, rows: int = 2800, trees: int = 16, depth: int = 3, rate: float = 0.4, precision: float = 0.98, seed: int = 5) -> Model:
    """Fits the trees on three quarters of `rows` template rows; thresholds on the last quarter.

    A kind's threshold is the lowest at which that quarter's precision, with one false case added, is at least `precision`;
    a kind that never is gets none.
    """
    data = spark.createDataFrame([(i, *x) for i, x in enumerate(_templates(rows, seed))], "i int, text string, label int, want string")
    picked = data.select("i", "label", "want", F.explode(F.filter(candidates(F.col("text")), lambda c: c["kind"] == F.col("want"))).alias("c"))
    columns = features(F.col("c"))
    names = tuple(columns)
    got = picked.select("i", "label", "want", *(v.alias(k) for k, v in columns.items())).orderBy("i").collect()
    x = np.array([[row[n] for n in names] for row in got], float)
    y = np.array([row["label"] for row in got], float)
    kinds, held = np.array([row["want"] for row in got]), np.array([row["i"] // (2 * len(GENERATORS)) % 4 == 3 for row in got])
    base = math.log(y[~held].mean() / (1 - y[~held].mean()))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x[~held], (y - p)[~held], (p * (1 - p))[~held], depth)
        out.append(tree)
        score = score + rate * _apply(tree, x)
    thresholds = {}
    for kind in GENERATORS:
        own = held & (kinds == kind)
        for cut in np.unique(score[own]):
            said = own & (score >= cut)
            if y[said].sum() / (said.sum() + 1) >= precision:
                thresholds[kind] = max(float(cut), 0.0)
                break
    shrink = lambda t: t if not isinstance(t, tuple) else (t[0], t[1], shrink(t[2]), shrink(t[3]))
    right = (score > 0) == (y > 0.5)
    return Model(base, tuple((rate, shrink(t)) for t in out), thresholds, names, {k: float(right[held & (kinds == k)].mean()) for k in GENERATORS if (held & (kinds == k)).any()})


def score(model: Model, values: Column) -> Column:
    """Raw score from an array of feature values, in the order of model.names."""

    def case(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, left, right = tree
        return F.when(values[f] < cut, case(left)).otherwise(case(right))

    total = F.lit(model.base)
    for rate, tree in model.trees:
        total = total + rate * case(tree)
    return total


def selected(model: Model, proposed: Column, base: Column) -> Column:
    """Candidates at or over their kind's threshold, by start, then the longest first, without those that lie wholly in a base span or in one selected before."""
    def passes(c):
        cut = F.lit(None).cast("double")
        for kind, t in model.thresholds.items():
            cut = F.when(c["kind"] == kind, F.lit(t)).otherwise(cut)
        columns = features(c)
        return F.coalesce(let(F.array(*(columns[n] for n in model.names)), lambda v: score(model, v)) >= cut, F.lit(False))

    free = F.filter(proposed, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    good = F.transform(F.filter(free, passes), lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    span = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value"))
    fold = F.aggregate(F.array_sort(good), F.struct(F.lit(-1).alias("to"), empty.alias("out")), lambda a, c: F.when(c["end"] > a["to"], F.struct(c["end"].alias("to"), F.concat(a["out"], F.array(span(c))).alias("out"))).otherwise(a), lambda a: a["out"])
    return F.when(F.size(proposed) > 0, fold).otherwise(empty)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds base (spans of the base kinds) and found (these and the method's), each by start, then kind."""
    model = model or fitted(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = base_spans(t)
    out = docs.withColumns({"_base": F.array_sort(F.concat(*kinds.values())), "_proposed": candidates(t)})
    out = out.withColumn("found", F.array_sort(F.concat(F.col("_base"), selected(model, F.col("_proposed"), F.col("_base")))))
    return out.withColumn("base", F.col("_base")).drop("_base", "_proposed")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    spanned = with_spans(docs, text)
    t = F.col(text)
    folded = F.aggregate(
        F.col("found"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))),
    )
    return spanned.withColumn(text, F.when(F.size("found") > 0, folded).otherwise(t)).select(*docs.columns)


def op2_pii_boosting(spark, sf_dir):
    """Counts, digest and spans of personal data in every text of `documents`."""
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return docs.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
