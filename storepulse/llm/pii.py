"""Personal data by weak supervision (operator 6), in built-in functions.

One scan finds the strict spans (email, ip, card, phone: always reported) and
loose candidates: card-like and phone-like numbers, social numbers, bank
numbers, spelled-out mail addresses, titled names.  Three labelers vote on
each candidate (1 personal, 0 not, -1 abstains): a regex labeler on its
form, a gazetteer labeler on known prefixes, and a context labeler on the words
before it.  Expectation-maximisation on the counts of vote patterns estimates
each labeler's reliability and each pattern's probability; a logistic span
classifier (form, length, separators, votes) is trained on these
probabilities and decides on every candidate.  EM and training read only the
table of pattern counts, whose size is bounded by the number of feature
combinations (a few thousand rows), however large the corpus.

Null or empty texts have no spans; repeated rows are each answered; where
there is no candidate nothing is learned; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm import spans as sp
from storepulse.llm.common import written

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["account", "telephone", "social", "bank", "mailbox", "name"]
KINDS = BASE + LOOSE

# Possessive forms of the contract's patterns: equal matches, no deep
# recursion and no quadratic scan of long runs.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
#: Sum of the digits from the right, every second one doubled.
_LUHN = f"""aggregate(split(reverse({_DIGITS}), ''), named_struct('odd', true, 'sum', 0L),
    (t, d) -> named_struct('odd', not t.odd, 'sum', t.sum + if(t.odd, cast(d as bigint), (2 * cast(d as bigint)) % 10 + (2 * cast(d as bigint)) div 10)),
    t -> t.sum % 10 = 0)"""

# Loose candidates and what the labelers know (fixed values).
ACCOUNT = r"(?<![0-9A-Za-z.,-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9A-Za-z-])"
TELEPHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BANK = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
MAILBOX = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63})+"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-zà-ÿ]+(?:\x20[A-Z][a-zà-ÿ]+)?"
PATTERNS = {"account": ACCOUNT, "telephone": TELEPHONE, "social": SOCIAL, "bank": BANK, "mailbox": MAILBOX, "name": NAME}
HINTS = {"account": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", "telephone": r"[0-9]{3}[\x20.-][0-9]{4}", "social": r"[0-9]-[0-9]{2}-[0-9]",
         "bank": r"[A-Z]{2}[0-9]{2}", "mailbox": r"[\[(](?:at|AT)[\])]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z]"}
FORM_YES = r"^[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}$|^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}|^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$|[\[(](?:at|AT)[\])].*(?:\.|dot|DOT)|\x20[A-Z][^\x20]+\x20[A-Z]"
FORM_NO = r"^([0-9])\1*$|^0{4}|1234567|^(?:000|666|9[0-9]{2})-"
GAZETTEER_YES = r"^(?:4|5[1-5]|34|37|6011|65)[0-9]|^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE)[0-9]{2}|(?:gmail|yahoo|outlook|hotmail|example)|^(?:Dr|Mr|Mrs|Ms|Herr|Frau)"
CONTEXT_YES = r"(?i)(?:phone|tel|call|mobile|fax|card|visa|account|iban|ssn|social security|mail|contact|name|konto|karte|telefon|carte|compte|tarjeta|cuenta|nombre)[^0-9\n]{0,12}$"
CONTEXT_NO = r"(?i)(?:order|invoice|isbn|version|ref|item|serial|part|case|page|artikel|bestell|commande|pedido|factura)[^0-9\n]{0,12}$"


def base_spans(text: str) -> list:
    """The strict spans of a non-null text column, one array per kind."""
    return [
        sp.matches(text, EMAIL, 0, only_if=f"contains({text}, '@')"),
        sp.matches(text, IP, 1, keep=f"{{v}} rlike {sp.quoted('^' + _PART + (chr(92) + '.' + _PART) * 3 + '$')}",
                   only_if=f"{text} rlike {sp.quoted(r'[0-9][.][0-9]+[.][0-9]+[.][0-9]')}"),
        sp.matches(text, CARD, 2, keep=f"length({{v}}) < 40 and length({_DIGITS}) between 14 and 19 and {_LUHN}",
                   only_if=f"{text} rlike {sp.quoted(r'[0-9](?:[ -]?[0-9]){13}')}"),
        sp.matches(text, PHONE, 3, keep=f"length({_DIGITS}) between 10 and 15", only_if=f"{text} rlike {sp.quoted(r'[+][0-9]')}"),
    ]


def scan(docs: DataFrame) -> DataFrame:
    """docs' columns but text, plus base and loose (arrays of spans with votes)."""
    others = [c for c in docs.columns if c not in ("text", "body_", "base", "loose")]
    t = docs.select(*others, F.coalesce("text", F.lit("")).alias("body_"))
    t = t.withColumn("base", sp.in_order(*base_spans("body_")))
    found = [sp.matches("body_", PATTERNS[k], len(BASE) + i, only_if=f"body_ rlike {sp.quoted(HINTS[k])}") for i, k in enumerate(LOOSE)]
    t = t.withColumn("found_", sp.apart(sp.in_order(*found), F.col("base")))

    def vote(yes, no, on):
        return F.when(on.rlike(no), 0).when(on.rlike(yes), 1).otherwise(-1)

    def voted(s):
        v = s["value"]
        ahead = F.substring(F.col("body_"), F.greatest(s["start"] - 39, F.lit(1)).cast("int"), F.least(s["start"], F.lit(40)).cast("int"))
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            vote(FORM_YES, FORM_NO, v).alias("form"),
            F.when(v.rlike(GAZETTEER_YES), 1).when(v.rlike(r"^[0-9]"), 0).otherwise(-1).alias("gazetteer"),
            vote(CONTEXT_YES, CONTEXT_NO, ahead).alias("context"),
            F.least(F.length(v).cast("int"), F.lit(24)).alias("length"),
            v.rlike(r"[\x20.-]").cast("int").alias("parted"))

    return t.select(*others, "base", F.transform("found_", voted).alias("loose"))


VOTES = ["form", "gazetteer", "context"]
FEATURES = ["kind", *VOTES, "length", "parted"]


def reliabilities(counts: dict[tuple, int], rounds: int = 50):
    """EM over vote patterns -> probability of each pattern to be personal.

    Two classes, labelers independent given the class; a labeler's accuracy
    starts at 0.8 and an abstention says nothing."""
    prior, right = 0.5, [[0.8, 0.8] for _ in VOTES]  # accuracy on personal and on other spans
    after = {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for (p, q), v in zip(right, votes, strict=True):
                if v >= 0:
                    yes += math.log(p if v == 1 else 1 - p)
                    no += math.log(q if v == 0 else 1 - q)
            after[votes] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        total = sum(counts.values())
        prior = min(0.95, max(0.05, (1 + sum(after[v] * n for v, n in counts.items())) / (2 + total)))
        for j in range(len(VOTES)):
            for c in (1, 0):
                weight = {v: n * (after[v] if c else 1 - after[v]) for v, n in counts.items() if v[j] >= 0}
                share = (4 + sum(w for v, w in weight.items() if v[j] == c)) / (5 + sum(weight.values()))
                right[j][1 - c] = min(0.99, max(0.55, share))  # labelers are better than chance
    return after, right, prior


def train(cells: list[tuple], soft: dict, rounds: int = 200, rate: float = 1.0, decay: float = 1e-3) -> dict[tuple[str, int], float]:
    """Logistic weights per (feature, value) from the cells (features, n)."""
    weights: dict[tuple[str, int], float] = {("bias", 0): 0.0}
    rows = []
    total = sum(n for _, n in cells)
    for values, n in cells:
        f = [("bias", 0), *zip(FEATURES, values, strict=True)]
        rows.append((f, n / total, soft[tuple(values[1:4])]))
        for k in f:
            weights.setdefault(k, 0.0)
    for _ in range(rounds):
        slope = {k: decay * w for k, w in weights.items()}
        for f, n, y in rows:
            z = sum(weights[k] for k in f)
            e = n * (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - y)
            for k in f:
                slope[k] += e
        for k in weights:
            weights[k] -= rate * slope[k]
    return weights


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs' columns but text, plus base and spans (arrays of start, kind,
    end; kind is an index into KINDS)."""
    seen = written(scan(docs), "pii")
    cells = [(tuple(r[:-1]), r[-1]) for r in seen.select(F.explode("loose").alias("s")).select("s.*").groupBy(*FEATURES).agg(
        F.count("*").alias("n")).orderBy(*FEATURES).collect()]  # bounded by the feature combinations
    plain = "transform({0}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    base = F.expr(plain.format("base"))
    if not cells:
        return seen.withColumn("base", base).withColumn("spans", F.col("base")).drop("loose")
    counts: dict[tuple, int] = {}
    for values, n in cells:
        counts[values[1:4]] = counts.get(values[1:4], 0) + n
    soft, _, _ = reliabilities(counts)
    weights = train(cells, soft)

    def score(s):
        z = F.lit(weights[("bias", 0)])
        for f in FEATURES:
            known = {v: w for (g, v), w in weights.items() if g == f}
            table = F.create_map(*[F.lit(x) for v, w in known.items() for x in (int(v), float(w))])
            z = z + F.coalesce(F.element_at(table, s[f].cast("int")), F.lit(0.0))
        return z

    cut = math.log(threshold / (1 - threshold))
    chosen = F.filter("loose", lambda s: score(s) >= cut)
    more = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return seen.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", more))).drop("loose")
