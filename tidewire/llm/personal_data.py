"""Personal data by weak supervision: base patterns always count, looser candidates when a trained classifier says so.

Every candidate span gets votes from three labelers: its pattern and checksum, a gazetteer, and the words before it. Votes
of all candidates are counted by combination; expectation maximisation over these counts (their number is bounded by the
combinations, not by the data) estimates how reliable each labeler is, and a logistic span classifier is trained on the
posteriors. Texts are read once; afterwards only candidates move.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import bind
from tidewire.llm.common import stored

LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")


@dataclass(frozen=True)
class Pattern:
    kind: str
    base: bool
    regex: str
    hint: str           # SQL over t_: false where the pattern cannot match


# The base patterns are written without backtracking into runs (possessive, and anchored to the start of a run or the end
# of the match before): the same leftmost matches, in linear time and without recursion over long runs.
PATTERNS = (
    Pattern("email", True, rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t_, '@') > 0"),
    Pattern("ip", True, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"t_ RLIKE r'[0-9]\.[0-9]++\.[0-9]'"),
    Pattern("card", True, r"[0-9](?:[\x20-]?+[0-9])++", r"t_ RLIKE r'[0-9](?:[\x20-]?+[0-9]){13}'"),
    Pattern("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"t_ RLIKE r'\+[0-9][\x20().0-9-]'"),
    Pattern("email", False, rf"(?:\G|(?<!{LOCAL})){LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
            "instr(t_, '(at)') > 0 OR instr(t_, '[at]') > 0"),
    Pattern("phone", False, r"(?<![0-9+().-])(?:\([0-9]{2,5}\)\x20?|[0-9]{3,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
            r"t_ RLIKE r'[0-9]{3,4}[\x20.-][0-9]{3,4}'"),
    Pattern("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
            r"t_ RLIKE r'[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}'"),
    Pattern("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"t_ RLIKE r'[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
)
CUES = {
    "email": "mail|contact|write|schreib|kontakt|correo|courriel|contacto|écri", "phone": "call|tel|phone|fax|mobile|cell|anruf|telefon|llam|appel",
    "ip": "address|server|host|login|client|user|logged|from ip|adresse", "card": "card|visa|mastercard|amex|karte|carte|tarjeta|payment|credit",
    "iban": "iban|account|konto|compte|cuenta|bank", "ssn": "ssn|social|security|insurance",
}
AGAINST = "version|isbn|issn|doi|order|invoice|serial|part no|model|build|release|rfc|section|figure|table|page"
TOP_LEVEL = ("com org net edu gov mil int info biz io co me de fr es it nl be ch at uk us ca au pl pt se no fi dk ie cz ru cn jp in br mx "
             "eu app dev example").split()


def is_valid(kind: Column, m: Column) -> Column:
    """What a base match has to pass; true for other patterns."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    part = F.regexp_replace
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(part(p, r"^0+(?=[0-9])", "")) <= 3)
                  & (part(p, r"^0+(?=[0-9])", "").try_cast("int") <= 255))
    luhn = F.expr("""aggregate(sequence(1, length(d_)), 0, (a, i) -> a + CASE WHEN (length(d_) - i) % 2 = 0 THEN int(substring(d_, i, 1))
                     WHEN int(substring(d_, i, 1)) > 4 THEN int(substring(d_, i, 1)) * 2 - 9 ELSE int(substring(d_, i, 1)) * 2 END) % 10 = 0""")
    return (F.when(kind == "ip", ip).when(kind == "card", n.between(14, 19) & luhn)
            .when(kind == "phone", n.between(10, 15)).otherwise(F.lit(True)))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every match of every pattern with its place and surroundings, and one row without a match for each document."""
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_"))
    none = "cast(array() AS array<string>)"
    cut = bind(whole, {f"{part}{k}": F.expr(f"CASE WHEN {p.hint} THEN {call} ELSE {none} END")
                       for k, p in enumerate(PATTERNS)
                       for part, call in (("m", f"regexp_extract_all(t_, r'({p.regex})', 1)"), ("g", f"split(t_, r'{p.regex}')"))})
    found = F.concat(*[F.expr(f"""transform(m{k}, (m, i) -> struct({k} AS p, i AS i, length(g{k}[i]) AS gap, m AS m,
                       right(g{k}[i], 40) AS before, left(g{k}[i + 1], 1) AS after))""") for k in range(len(PATTERNS))])
    return cut.select("row", "key", F.explode_outer(found).alias("c")).select("row", "key", "c.*")


def labelled(found: DataFrame) -> DataFrame:
    """Places (code points), the base verdict, votes and features of each candidate."""
    run = Window.partitionBy("row", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(run)
    kinds = F.array(*[F.lit(p.kind) for p in PATTERNS])
    bases = F.array(*[F.lit(p.base) for p in PATTERNS])
    placed = bind(found.withColumns({"kind": F.get(kinds, F.col("p")), "strict": F.get(bases, F.col("p")), "end": end}), {
        "start": F.col("end") - F.length("m"), "d_": F.regexp_replace("m", "[^0-9]", ""), "cue_": F.lower("before")})
    valid = bind(placed, {"valid": F.coalesce(is_valid(F.col("kind"), F.col("m")), F.lit(False))})
    cue = F.lit(0)
    for kind, words in CUES.items():
        cue = F.when((F.col("kind") == kind) & F.col("cue_").rlike(words), 1).otherwise(cue)
    cue = F.when(F.col("cue_").rlike(AGAINST), -1).otherwise(cue)
    last = F.lower(F.element_at(F.split("m", r"[.\x20\])]+"), -1))
    gazetteer = (F.when(F.col("kind") == "email", F.when(last.isin(TOP_LEVEL), 1).otherwise(-1))
                 .when(F.col("kind") == "card", F.when(F.col("d_").rlike("^[3-6]"), 1).otherwise(-1))
                 .when(F.col("kind") == "phone", F.when(F.length("d_").between(9, 15), 1).otherwise(-1))
                 .when(F.col("kind") == "ip", F.when(F.col("m").rlike(r"^(?:0|255)\."), -1).otherwise(1))
                 .when(F.col("kind") == "ssn", F.when(F.col("m").rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
                 .otherwise(0))
    pattern = F.when(F.col("strict") & F.col("valid"), 1).when(F.col("strict"), -1).otherwise(0)
    glued = F.when(F.substring("before", -1, 1).rlike(r"[\p{L}\p{N}_]") | F.col("after").rlike(r"[\p{L}\p{N}_]"), 1).otherwise(0)
    size = F.when(F.length("m") < 8, 0).when(F.length("m") < 14, 1).when(F.length("m") < 22, 2).otherwise(3)
    return valid.select("row", "key", "kind", "start", "end", (F.col("strict") & F.col("valid")).alias("base"), "p",
                        F.when(F.col("m").isNotNull(), F.struct(pattern.alias("pattern"), gazetteer.alias("gazetteer"), cue.alias("cue"),
                                                                glued.alias("glued"), size.alias("size"))).alias("v"))


@dataclass
class SpanModel:
    """Reliabilities by labeler and class, and the classifier's weights by feature value."""

    reliability: dict[str, list[list[float]]]
    weights: dict[tuple[str, object], float]

    def score(self) -> Column:
        total = F.lit(self.weights.get(("bias", 0), 0.0))
        for (name, value), w in self.weights.items():
            if name != "bias":
                column = F.col("kind") if name == "kind" else F.col(f"v.{name}")
                total = total + F.when(column == F.lit(value), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


LABELERS = ("pattern", "gazetteer", "cue")
FEATURES = ("kind", "gazetteer", "cue", "glued", "size")


def fit(counted: list, rounds: int = 50) -> SpanModel:
    """From rows (kind, pattern, gazetteer, cue, glued, size, n): a two-class model with abstaining labelers, then the classifier."""
    if not counted:
        return SpanModel({}, {("bias", 0): -4.0})
    n = np.array([r["n"] for r in counted], float)
    votes = np.array([[r[j] for j in LABELERS] for r in counted], int) + 1
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))
    tables = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for j in range(len(LABELERS)):
            for y, p in ((0, 1 - post), (1, post)):
                # a labeler is taken to be better than chance until many votes say otherwise
                at = np.array([8.0, 4.0, 2.0]) if y == 0 else np.array([2.0, 4.0, 8.0])
                at += np.bincount(votes[:, j], weights=n * p, minlength=3)
                tables[j, y] = at / at.sum()
        odds = math.log(prior / (1 - prior)) + sum(np.log(tables[j, 1, votes[:, j]] / tables[j, 0, votes[:, j]]) for j in range(len(LABELERS)))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    values = sorted({(f, r[f]) for r in counted for f in FEATURES}, key=str)
    place = {v: i + 1 for i, v in enumerate(values)}
    x = np.zeros((len(counted), len(values) + 1))
    x[:, 0] = 1
    for i, r in enumerate(counted):
        for f in FEATURES:
            x[i, place[f, r[f]]] = 1
    w, weight = np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1e6)
    for _ in range(30):                                 # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (post - p)) - w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return SpanModel({name: tables[j].tolist() for j, name in enumerate(LABELERS)},
                     {("bias", 0): float(w[0])} | {v: float(w[i]) for v, i in place.items()})


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per input row.

    Base spans always count; a candidate of a looser pattern, or one that failed its base check, is added as a span if the
    classifier gives it `least` and it overlaps no base span. Places are code points. A null or empty text has no spans; null
    keys and repeated rows stay rows of their own; other columns are not read.
    """
    found = stored(labelled(candidates(docs, key, text)), "personal-data")
    counted = (found.where("v IS NOT NULL").groupBy("kind", *[F.col(f"v.{c}").alias(c) for c in (*LABELERS, "glued", "size")])
               .agg(F.count(F.lit(1)).alias("n")).collect())                     # a row per combination: a few thousand at most
    model = fit(counted)
    by_place = Window.partitionBy("row").orderBy("start")
    judged = found.withColumns({
        "reach": F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rangeBetween(Window.unboundedPreceding, 0)),
        "next": F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rangeBetween(0, Window.unboundedFollowing)),
        "p_": model.score()})
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "kind", "end")
    base = F.col("base") & F.col("start").isNotNull()
    added = ~F.col("base") & F.col("start").isNotNull() & free & (F.col("p_") >= least)

    def count(kind: str) -> Column:
        return F.count(F.when(base & (F.col("kind") == kind), 1)).alias(f"n_{kind}")

    def written(spans: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.array_distinct(spans)), lambda s: F.concat_ws(
            ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    grouped = judged.groupBy("row", "key").agg(
        *[count(k) for k in ("email", "ip", "card", "phone")],
        F.collect_list(F.when(base, span)).alias("base_"), F.collect_list(F.when(base | added, span)).alias("all_"))
    return grouped.select(F.col("key").alias(key), "n_email", "n_ip", "n_card", "n_phone",
                          F.sha2(written("base_"), 256).alias("base_sha256"), written("all_").alias("spans"))
