"""Personal data by candidate gradient boosting. Native: column functions only.

Four base kinds are found by pattern and check. Beyond them, generators with high
recall propose spans, which may overlap: disguised mail addresses, longer network
addresses, digits that could be a card or a telephone number, identity and account
numbers. Boosted trees score each candidate by its format and by the words around
it; a candidate is selected if its calibrated probability reaches the threshold of
its kind and it touches no base span.

The trees are fit here, on sentences made from the templates below and on
candidates of a bounded sample of documents, both reduced by Spark to counts of
distinct feature rows. Fitted trees are column expressions.
"""

from __future__ import annotations

import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from shoal.functions.binding import with_computed
from shoal.llm.spans import apart, found, running

# The base kinds, in order. The patterns are those of the contract, with
# loops that give nothing back and starts at the head of a run, so that they stay linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){12})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)
# All kinds: the base kinds, then those that only candidates have.
KINDS = (*BASE, "natid", "account")

# Characters on either side of a candidate that its features see.
AROUND = 32
# Generators: kind and pattern.
AT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
GENERATORS = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]?[0-9]{2,7}){2,5}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.,])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,3}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])"),
    ("natid", r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z-])"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
)

# Words around a candidate, one feature each, in the languages of the templates.
CONTEXT = {
    "phone_words": r"(?i)\b(?:tel|phone|call|calls?|fax|mobile|cell|dial|ring|text me|whatsapp|telefon|handy|ruf|anrufen|t[ée]l[ée]phone|appel\w*|joindre|tel[ée]fono|m[óo]vil|llam\w*)\b",
    "card_words": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|kreditkarte|karte|carte|tarjeta|cvv|cvc|expir\w*)\b",
    "natid_words": r"(?i)\b(?:ssn|social security|national id|passport|taxpayer|tax id|ausweis|sozialversicherung\w*|s[ée]curit[ée] sociale|dni|seguridad social)\b",
    "account_words": r"(?i)\b(?:iban|bic|account|bank|wire|konto|kontonummer|[üu]berweis\w*|compte|virement|cuenta|transferencia)\b",
    "mail_words": r"(?i)\b(?:e-?mails?|contact|write|mail|reach|reachable|schreib\w*|[ée]cri\w*|correo|escrib\w*)\b",
    "net_words": r"(?i)\b(?:ip|ipv6|address|addr|host|client|login|logged|adresse|direcci[óo]n|connected|connection)\b",
    "other_words": r"(?i)(?:\b(?:order|invoice|isbn|issn|version|ref|page|pages|pp|price|total|date|time|serial|sku|tracking|model|score|ratio|figure|fig|table|lines?|commit|hash|doi|token|password|secret|key|api|parcel|part|number of|results?|population|between|from \d+|bestellung|rechnung|commande|facture|pedido|factura|meet\w*|look\w*|mac|device)\b|[$€£#%])",
}
FEATURES = (
    "kind", "digits", "letters", "groups", "length", "checked", "lead", "separator", "widest", "narrowest", "touching",
    "dated", "monotone", *CONTEXT,
)

# Sentences with a place for a value, by kind; NEITHER holds no personal data.
TEMPLATES = {
    "email": (
        "You can write to {} for details", "email: {}", "contact {} about the flat", "schreiben Sie an {} bitte", "e-mail {} or come by",
        "mon adresse mail est {} merci", "escribe a {} hoy", "reach me under {}",
    ),
    "ip": ("the client {} logged in", "ip {} was seen", "connection from host {} closed", "IPv6 address: {}", "adresse {} connected"),
    "card": (
        "my credit card {} expires soon", "card number: {}", "visa {} cvv 123", "Kreditkarte {} bitte", "carte {} valide", "tarjeta {} de mi padre",
        "please charge {} to the mastercard",
    ),
    "phone": (
        "call me at {} tonight", "phone: {}", "tel. {} ext 4", "fax {} or mobile", "Telefon {} abends", "mon téléphone {} merci", "llama al {} hoy",
        "her mobile {} is off", "dial {} for the office", "you can ring {} any time", "WhatsApp {}",
    ),
    "natid": ("his ssn is {} as filed", "social security number {}", "SSN: {}", "taxpayer {} was audited", "national id {} on file"),
    "account": (
        "IBAN {} at the bank", "wire it to account {} please", "Konto {} bei der Bank", "compte {} merci", "cuenta {} en el banco",
        "Überweisung auf {} bis Freitag",
    ),
}
NEITHER = (
    "order {} was shipped", "invoice {} is due", "ISBN {} second edition", "version {} is out", "ref {} in the file", "pages {} of the book",
    "the total was $ {} last year", "serial {} on the box", "tracking {} of the parcel", "results {} in table 4", "between {} and later",
    "date {} noted", "time {} noted", "commit {} broke it", "token {} expired", "device mac {} seen", "Bestellung {} ist da", "facture {} payée",
    "pedido {} enviado", "score {} after overtime", "part {} is out of stock", "doi {} cited", "the ratio {} was found", "we look {} for it",
    "we meet {} tomorrow", "population {} counted", "and {} of the", "le {} et la", "der {} und die", "hash {} differs", "api key {} revoked",
)

SAMPLE_DOCS = 4_000  # documents whose candidates join the fit
FIT_ROWS = 20_000  # distinct feature rows of the fit
VARIANTS = 10  # values per template
FOLD = 4  # one template in so many is kept for calibration
SAMPLE_SHARE = 0.25  # weight of the sampled candidates against the templates
ROUNDS, DEPTH, RATE, RIDGE = 40, 3, 0.3, 1.0
PRECISION, LEAST = 0.98, 0.5


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    turned = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def account_check(text: Column) -> Column:
    """Whether an account number's remainder modulo 97 is 1, its first four characters moved to the end."""
    plain = F.regexp_replace(text, "[^0-9A-Z]", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _spans(hits: Column, kind: int) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kind).alias("kind"), h["end"].alias("end")))


def base_spans(body: Column) -> Column:
    """(start, kind, end) of the base kinds: leftmost matches that pass their check."""
    def sized(text: Column, bounds: tuple[int, int]) -> Column:
        return F.length(digits_of(text)).between(*bounds)

    ips = F.filter(found(body, IP), lambda h: h["match"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    cards = F.filter(found(body, CARD), lambda h: sized(h["match"], CARD_DIGITS))
    cards = F.filter(cards, lambda h: luhn(digits_of(h["match"])))
    phones = F.filter(found(body, PHONE), lambda h: sized(h["match"], PHONE_DIGITS))
    return F.concat(_spans(found(body, EMAIL), 0), _spans(ips, 1), _spans(cards, 2), _spans(phones, 3))


def candidates(body: Column) -> Column:
    """Spans that the generators propose, with the text around them."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(found(body, pattern, AROUND), lambda h: F.struct(
            h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), h["end"].alias("end"), h["match"].alias("match"),
            h["before"].alias("before"), h["after"].alias("after"),
        ))

    return F.concat(*[of(*g) for g in GENERATORS])


def features(c: Column) -> Column:
    """Format and context of a candidate as small numbers, in the order of FEATURES."""
    text, around = c["match"], F.concat(c["before"], F.lit(" | "), c["after"])
    digits = digits_of(text)
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    widths = F.transform(groups, lambda g: F.length(g))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    def capped(value: Column, most: int) -> Column:
        return F.least(F.coalesce(value, F.lit(0)), F.lit(most))

    separators = F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[0-9A-Za-z+()]", ""), ""), lambda s: s != ""))
    separator = F.when(F.size(separators) == 0, 0).when(F.size(separators) > 1, 5)
    for k, mark in enumerate((" ", "-", "."), 1):
        separator = separator.when(F.array_contains(separators, mark), k)
    checked = F.when(c["kind"] == KINDS.index("account"), account_check(text)).when(F.length(digits).between(*CARD_DIGITS), luhn(digits))
    values = {
        "kind": c["kind"], "digits": capped(F.length(digits), 20),
        "letters": capped(F.length(F.regexp_replace(text, "[^A-Za-z]", "")), 20), "groups": capped(F.size(groups), 8),
        "length": capped(F.length(text), 40), "checked": flag(checked),
        "lead": F.when(text.rlike(r"^(?:\+|00)"), 2).when(text.startswith("("), 1).otherwise(0), "separator": separator.otherwise(4),
        "widest": capped(F.array_max(widths), 12), "narrowest": capped(F.array_min(widths), 12),
        "touching": flag(c["before"].rlike(r"""[0-9A-Za-z=/#:._$€"'&?+*-]$""")) + 2 * flag(c["after"].rlike("""^[0-9A-Za-z=/#:_$€"'&*%-]""")),
        "dated": flag(text.rlike(r"^(?:[12][0-9]{3}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:[12][0-9]{3}|[0-9]{2}))")),
        "monotone": flag(digits.rlike("^([0-9])\\1*$")),
    }
    values |= {name: flag(around.rlike(pattern)) for name, pattern in CONTEXT.items()}
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


class Detector(NamedTuple):
    """Trees as nested (feature, bound, left, right) with numbers as leaves; calibration; thresholds by kind."""

    trees: list
    slope: float
    shift: float
    thresholds: dict[str, float]
    quality: dict[str, tuple[float, float]]  # precision and recall on what calibrated each kind

    def probability(self, x: Column) -> Column:
        def value(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, bound, left, right = tree
            return F.when(x[feature] <= bound, value(left)).otherwise(value(right))

        # added up in pairs, so that the expression stays shallow
        parts = [value(t) for t in self.trees]
        while len(parts) > 1:
            parts = [sum(parts[i + 1 : i + 2], parts[i]) for i in range(0, len(parts), 2)]
        margin = parts[0] if parts else F.lit(0.0)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))

    def selects(self, kind: Column, probability: Column) -> Column:
        least = F.lit(2.0)
        for name, bound in self.thresholds.items():
            least = F.when(kind == KINDS.index(name), bound).otherwise(least)
        return probability >= least


def _grown(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree of second-order gain over small whole numbers."""
    total_g, total_h = grad.sum(), hess.sum()
    leaf = float(-RATE * total_g / (total_h + RIDGE))
    best = (1e-6, None, None)
    if depth and len(x):
        for f in range(x.shape[1]):
            g, h = np.bincount(x[:, f], grad).cumsum(), np.bincount(x[:, f], hess).cumsum()
            rest_g, rest_h = total_g - g, total_h - h
            gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain[(h < RIDGE) | (rest_h < RIDGE)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (gain[k], f, k)
    _, f, bound = best
    if f is None:
        return leaf
    low = x[:, f] <= bound
    return (FEATURES[f], bound, _grown(x[low], grad[low], hess[low], depth - 1), _grown(x[~low], grad[~low], hess[~low], depth - 1))


def _applied(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, bound, left, right = tree
    return np.where(x[:, FEATURES.index(feature)] <= bound, _applied(left, x), _applied(right, x))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Detector:
    """Fit trees to the rows that are not `held`, calibrate margins and choose thresholds on those that are."""
    trees, margin = [], np.zeros(len(y))
    use = ~held & (weight > 0)
    for _ in range(ROUNDS if y[use].any() and not y[use].all() else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grown(x[use], (weight * (p - y))[use], (weight * p * (1 - p))[use], DEPTH)
        trees.append(tree)
        margin += _applied(tree, x)
    # a logistic curve of the margin, by Newton's steps
    a, b = 1.0, 0.0
    m, t, w = margin[held], y[held], weight[held]
    for _ in range(50 if t.any() and not t.all() else 0):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(w * (p - t) * m).sum() + 1e-2 * (a - 1), (w * (p - t)).sum() + 1e-2 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-2, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
    thresholds, quality = {}, {}
    for k, name in enumerate(KINDS):
        mine = held & (x[:, 0] == k)
        if not (mine & (y > 0)).any():
            continue  # nothing learned of this kind: its candidates are never selected
        for bound in sorted({LEAST, *p[mine & (p >= LEAST)].tolist()}):
            chosen = mine & (p >= bound)
            right = (weight * y)[chosen].sum()
            if chosen.any() and right >= PRECISION * weight[chosen].sum():
                # a hair below, for the other order of sums in the column form
                thresholds[name] = float(bound - 1e-9)
                quality[name] = (float(right / weight[chosen].sum()), float(right / (weight * y)[mine].sum()))
                break
    return Detector(trees, float(a), float(b), thresholds, quality)


def _check_digit(digits: str) -> str:
    """The digit that makes a number pass Luhn's check."""
    total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _made(kind: str, rng: random.Random) -> str:
    """A made-up value of a kind, or for "" something that is none."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(n: int) -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(n))

    def hexes(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    if kind == "email":
        at, dot = rng.choice([(" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT ")])
        return f"{word(6)}{rng.choice(['', '.' + word(5), digits(2)])}{at}{word(7)}{dot}{rng.choice(['com', 'org', 'de', 'net'])}"
    if kind == "ip":
        return ":".join(hexes(rng.randint(2, 4)) for _ in range(rng.choice([6, 8, 8])))
    if kind == "card":
        n = rng.choice([13, 15, 16, 16, 16])
        body = rng.choice("3456") + digits(n - 2)
        body += _check_digit(body)
        sep = rng.choice(["", " ", "-", ".", "/"])
        return sep.join(body[i : i + 4] for i in range(0, n, 4)) if sep else body
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"00{rng.randint(1, 49)} {a} {b}{digits(2)}", f"0{a}/{b}{digits(3)}",
            f"{b}-{c}", f"0{rng.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{rng.randint(1, 9)} {a} {b} {c}",
        ])
    if kind == "natid":
        sep = rng.choice(["-", "-", " "])
        return f"{rng.randint(1, 8)}{digits(2)}{sep}{digits(2)}{sep}{digits(4)}"
    if kind == "account":
        land, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), digits(rng.choice([18, 20, 16]))
        value = int("".join(str(int(ch, 36)) for ch in body + land + "00"))
        whole = f"{land}{98 - value % 97:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.7 else whole
    return rng.choice([
        f"{digits(3)}-{digits(7)}", f"{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}",
        f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(10, 30)}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", digits(rng.randint(12, 19)),
        f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}", f"{digits(3)}-{digits(2)}-{digits(4)}",
        ":".join(hexes(2) for _ in range(6)), hexes(32), f"{rng.choice(['AB', 'XK', 'PO'])}{digits(2)} {digits(4)} {digits(4)} {digits(2)}",
        f"{digits(3)} {digits(3)} {digits(3)}", f"10.{digits(4)}/{digits(6)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{word(5)} at {word(6)}.{word(4)}",
        f"{digits(4)}-{digits(4)}", f"{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)}.{digits(3)}.{digits(4)}",
    ])


def sentences(variants: int = VARIANTS, seed: int = 11) -> list[tuple[str, int, bool]]:
    """(sentence, kind number or -1, whether it calibrates), from the templates."""
    rng, out = random.Random(seed), []
    for kind, templates in [*TEMPLATES.items(), ("", NEITHER)]:
        number = KINDS.index(kind) if kind else -1
        for i, template in enumerate(templates):
            out += [(template.format(_made(kind, rng)), number, i % FOLD == FOLD - 1) for _ in range(variants)]
    return out


def _feature_rows(rows: DataFrame) -> DataFrame:
    """One row of features per candidate, next to the other columns; `body` holds the text."""
    # computed once, above all filters: the explode would filter on the candidates before the sample is taken
    proposed = with_computed(rows, base=base_spans(F.col("body")), proposed=candidates(F.col("body")))
    spread = proposed.withColumn("c", F.explode("proposed")).drop("proposed", "body")
    in_base = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    same = F.exists("base", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["kind"] == F.col("c.kind")))
    spread = spread.withColumns({"in_base": in_base, "same": same, "x": features(F.col("c"))})
    return spread.drop("base", "c")


def fit_detector(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> Detector:
    """Learn from the templates' sentences and from candidates of about SAMPLE_DOCS documents.

    The sample is taken by a hash of id and text. Its candidates that are base
    spans count as personal data, those that touch none as nothing of the kind;
    together they weigh SAMPLE_SHARE of the sentences. Only counts of distinct
    feature rows come to the driver, FIT_ROWS at most. Without a document the
    sentences alone are learned.
    """
    spark = docs.sparkSession
    made = spark.createDataFrame(sentences(), "body string, planted int, held boolean")
    learned = _feature_rows(made).select(
        ((F.col("x.kind") == F.col("planted"))).cast("int").alias("y"), "held", F.lit(False).alias("sampled"), "x"
    )
    n = docs.count()
    body = F.coalesce(F.col(text), F.lit(""))
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    chance = F.pmod(F.xxhash64(ident, text), F.lit(1_000_000).cast("long"))
    sample = docs.where(chance < int(share * 1_000_000)).select(body.alias("body"), (chance % FOLD == FOLD - 1).alias("held"))
    seen = _feature_rows(sample).where(F.col("same") | ~F.col("in_base"))
    seen = seen.select(F.col("same").cast("int").alias("y"), "held", F.lit(True).alias("sampled"), "x")
    counts = learned.unionByName(seen).groupBy("y", "held", "sampled", "x").agg(F.count("*").alias("n"))
    # sentences first: they are few
    rows = counts.orderBy("sampled", F.xxhash64("x", "y", "held"), "x", "y", "held").limit(FIT_ROWS).collect()
    x = np.array([tuple(r["x"]) for r in rows], np.int64).reshape(-1, len(FEATURES))
    y, held, sampled, weight = (np.array([r[c] for r in rows], t) for c, t in (("y", float), ("held", bool), ("sampled", bool), ("n", float)))
    if sampled.any():
        weight[sampled] *= SAMPLE_SHARE * weight[~sampled].sum() / weight[sampled].sum()
    return boost(x, y, weight, held)


def detect(docs: DataFrame, model: Detector, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of each text: ident, base and added, arrays of (start, kind, end).

    `kind` numbers KINDS. Places are code points, the end is exclusive. Added spans
    are candidates that the trees select and that touch no base span; they may
    overlap each other. A null or empty text has none; ties and repeated rows
    are scanned alike; an empty table gives no rows; other columns are not read.
    One narrow stage, linear in the matches of a text, however long it is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).alias("ident"), body.alias("body"))
    rows = rows.select("ident", base_spans(F.col("body")).alias("base"), candidates(F.col("body")).alias("proposed"))
    # what touches a base span is not scored
    rows = rows.select("ident", "base", apart(F.col("proposed"), F.col("base")).alias("proposed"))
    rows = rows.select("ident", "base", F.transform("proposed", lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), features(c).alias("x"))).alias("proposed"))
    chosen = F.filter("proposed", lambda c: model.selects(c["kind"], model.probability(c["x"])))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select(F.col("ident").alias(ident), "base", F.array_sort(added).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every stretch of overlapping spans replaced by the name of its first kind, as <EMAIL>."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(line: Column) -> Column:
        reach = running(F.transform(line, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(line) - 1))
        after = F.concat(F.slice(F.transform(line, lambda s: s["start"]), F.lit(2), F.size(line)), F.array(F.lit(2**31 - 1)))
        whole = F.arrays_zip(line.alias("s"), before.alias("before"), reach.alias("reach"), after.alias("after"))
        first = F.filter(whole, lambda w: (w["s"]["start"] >= w["before"]))
        heads = F.transform(first, lambda w: F.concat(
            F.substring(text, w["before"] + 1, w["s"]["start"] - w["before"]), F.element_at(names, w["s"]["kind"] + 1)
        ))
        return F.concat(F.array_join(heads, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(F.array(F.array_sort(spans)), cut), 1)).otherwise(text)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans, one row per document."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind]}")

    return detect(docs, fit_detector(docs)).select(
        "doc_id", *[count(k) for k in range(len(BASE))], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
