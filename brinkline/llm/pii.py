"""Personal data: base patterns plus candidate gradient boosting, in SQL expressions only.

High-recall generators propose overlapping spans of further kinds.  Boosted
regression trees (fitted here in numpy on a bounded, seeded set of labelled
lines, whose features come from the same SQL expressions) use the format and
the context of each candidate; Platt scaling and a threshold per kind,
chosen on held-out lines, select what is redacted.  The trees are compiled to
CASE expressions, so a text is read once, in one projection, without a
shuffle or Python on the executors.

Defined results: null and empty texts have no span; texts are read whole;
spans are ordered by start, then kind in the order of ``KINDS``, then end;
repeated rows are treated each by itself; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("at_mail", "tel", "ssn", "iban", "date", "number")
KINDS = BASE + MORE

#: Base patterns.  Possessive repeats and the anchors in front change no match
#: (one that starts inside a run would have started with the run), but keep
#: the scan linear.
BASE_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE_PATTERN = {
    "at_mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,}+)++",
    "tel": r"(?<![0-9])(?:\([0-9]{2,5}\)[\x20.-]?[0-9]{2,7}(?:[\x20.-][0-9]{2,7})*+|[0-9]{2,7}(?:[\x20.-][0-9]{2,7})++)(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?![0-9])",
    "number": r"(?<![0-9])[0-9]{7,}+",
}
#: Cheap tests that a text without any match fails.
GUARD: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.contains("+"),
    "at_mail": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]") | (t.contains(" at ") & (t.contains(".") | t.contains("dot"))),
}
DIGITS = r"[0-9]"

#: Context words, lower case.
CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "contact"),
    "person": ("ssn", "social security", "passport", "licence", "license no", "patient", "national id", "taxpayer"),
    "birth": ("born", "birth", "dob", "b-day"),
    "bank": ("iban", "account", "acct", "bank", "transfer", "bic"),
    "mail": ("mail", "write", "reach", "contact"),
    "other": ("order", "version", "invoice", "isbn", "serial", "page", "item", "ref", "build", "part no", "score", "released", "updated", "copyright"),
}
#: Forms that a candidate's text may have besides its kind.
FORMS = {
    "is_date": r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})$",
    "is_ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "bracket": r"[(\[]",
    "leading_zero": r"^\(?0",
    "spelt_dot": r"\x20dot\x20|[(\[]dot[)\]]",
    "marked_name": r"^[A-Za-z0-9%+-]*[._0-9][A-Za-z0-9._%+-]*\x20?[@(\[\x20]",
    "thousands": r"^[0-9]{2,3}(?:[\x20.]000)+$",
}
FEATURES = (*MORE, "digits", "letters", "separators", "length", "distinct_separators", *CUES, *FORMS, "parts", "first_part", "last_part", "sep_before", "word_before", "letter_after")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Running sums of an array of integers, in blocks of about its root."""

    def simple(xs: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
        return F.aggregate(xs, F.array().cast("array<int>"), step)

    def blocked(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: simple(F.slice(xs, k * width + 1, width)))
        return let(blocks, lambda bs: let(simple(F.transform(bs, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(F.transform(bs, lambda b, k: F.transform(b, lambda x: x + F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1)))).otherwise(0))))))

    return F.when(F.size(lengths) <= 48, simple(lengths)).otherwise(blocked(lengths))


NO_SPAN = "array<struct<start:int,kind:int,end:int,hit:string,before:string,after:string>>"


NEAR = 48  # characters in front of a candidate in which cues count


def spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern with their places in code points and what stands around them
    (in front: to the match before the last one, if that is nearer than ``NEAR``)."""

    def before(s: Column, i: Column) -> Column:
        return F.lower(F.right(F.concat_ws("", F.right(F.get(s["gaps"], i - 1), F.lit(NEAR)), F.get(s["hits"], i - 1), F.get(s["gaps"], i)), F.lit(NEAR)))

    def placed(s: Column) -> Column:
        ends = running(F.transform(s["hits"], lambda h, i: F.length(h) + F.length(F.get(s["gaps"], i))))
        return let(
            ends,
            lambda e: F.transform(
                s["hits"],
                lambda h, i: F.struct(
                    (F.get(e, i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), h.alias("hit"),
                    before(s, i).alias("before"), F.left(F.get(s["gaps"], i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(both, placed)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        v = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


#: What a base match must satisfy besides its pattern.
VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.when(F.regexp_replace(p, "^0+", "") == "", 0).otherwise(999)) <= 255)),
    "card": lambda s: let(digits(s["hit"]), lambda d: F.length(d).between(12, 19) & luhn(d)),
    "phone": lambda s: F.length(digits(s["hit"])).between(9, 15),
}


def base(text: Column) -> Column:
    """Spans of the base patterns, sorted by start and kind."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(NO_SPAN)
    found = [F.when(GUARD.get(k, lambda x: x.rlike(DIGITS))(t), F.filter(spans(t, BASE_PATTERN[k], i), VALID[k])).otherwise(none) for i, k in enumerate(BASE)]
    return F.array_sort(F.concat(*found))


def candidates(text: Column) -> Column:
    """Overlapping proposals of the other kinds."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(NO_SPAN)
    return F.concat(*[F.when(GUARD.get(k, lambda x: x.rlike(DIGITS))(t), spans(t, MORE_PATTERN[k], len(BASE) + i)).otherwise(none) for i, k in enumerate(MORE)])


def features(s: Column) -> Column:
    num = lambda c: c.cast("double")
    out = [num(s["kind"] == len(BASE) + i) for i in range(len(MORE))]
    kept = F.regexp_replace(s["hit"], r"[A-Za-z0-9]", "")
    out += [num(F.length(digits(s["hit"]))), num(F.length(F.regexp_replace(s["hit"], "[^A-Za-z]", ""))), num(F.length(kept)), num(s["end"] - s["start"]), num(F.size(F.array_distinct(F.split(kept, ""))))]
    out += [num(s["before"].rlike("|".join(words))) for words in CUES.values()]
    out += [num(s["hit"].rlike(form)) for form in FORMS.values()]
    part = lambda pattern: num(F.length(F.regexp_extract(s["hit"], pattern, 1)))
    out += [num(F.size(F.split(s["hit"], r"[^A-Za-z0-9]+"))), part(r"^\(?([0-9]*)"), part(r"([0-9]*)$")]
    out += [num(s["before"].rlike(r"[:=#]\s*$")), num(s["before"].rlike(r"\b(?:on|is|me|us|him|her|them|under|via|to)[\s:,]*$")), num(s["after"].rlike("[A-Za-z]"))]
    return F.array(*out)


@dataclass(frozen=True)
class Tree:
    feature: int
    cut: float
    low: Tree | float
    high: Tree | float

    def predict(self, x: np.ndarray) -> np.ndarray:
        side = lambda t: t.predict(x) if isinstance(t, Tree) else np.full(len(x), t)
        return np.where(x[:, self.feature] <= self.cut, side(self.low), side(self.high))

    def sql(self, f: Column) -> Column:
        side = lambda t: t.sql(f) if isinstance(t, Tree) else F.lit(float(t))
        return F.when(F.get(f, self.feature) <= self.cut, side(self.low)).otherwise(side(self.high))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int = 8, ridge: float = 1.0) -> Tree | float:
    """A regression tree by the second-order gain."""
    leaf = float(grad.sum() / (hess.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    whole, best = grad.sum() ** 2 / (hess.sum() + ridge), (1e-6, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= cut
            if least <= low.sum() <= len(x) - least:
                gain = grad[low].sum() ** 2 / (hess[low].sum() + ridge) + grad[~low].sum() ** 2 / (hess[~low].sum() + ridge) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, j, float(cut))
    if best[0] <= 1e-6:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[low], grad[low], hess[low], depth - 1, least, ridge), grow(x[~low], grad[~low], hess[~low], depth - 1, least, ridge))


@dataclass(frozen=True)
class PiiModel:
    trees: tuple
    rate: float
    scale: tuple[float, float]  # Platt: p = 1 / (1 + exp(-(a * margin + b)))
    cut: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((t.predict(x) if isinstance(t, Tree) else np.full(len(x), t) for t in self.trees), np.zeros(len(x)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))

    def sql(self, s: Column) -> Column:
        """The calibrated probability of a candidate."""
        value = lambda f: reduce(lambda a, b: a + b, [t.sql(f) if isinstance(t, Tree) else F.lit(t) for t in self.trees])
        return let(features(s), lambda f: 1 / (1 + F.exp(-(F.lit(self.scale[0] * self.rate) * value(f) + F.lit(self.scale[1])))))

    def picked(self, s: Column) -> Column:
        limit = F.element_at(F.array(*[F.lit(self.cut[k]) for k in MORE]), s["kind"] - len(BASE) + 1)
        return self.sql(s) >= limit


#: Sentences around personal values and around the same shapes in other use, by kind.  They are written as prose and
#: decide the labels; whether one of ``CUES`` is among their words plays no part.
PERSONAL = {
    "tel": ("You get hold of our clinic on {v}", "Mum's new number is {v}", "text me under {v} tonight", "the plumber left {v} on a note", "Reception: {v}, ask for Mia", "just dial {v} and wait", "he scribbled {v} on the back of the card", "for bookings {v} (evenings)", "tel {v}", "my mobile is {v}", "please call {v}", "fax us at {v}", "she can be reached on {v}", "Office {v}, home the same", "give them a ring on {v}", "WhatsApp {v}"),
    "ssn": ("hers reads {v}", "SSN {v}", "on the tax form he put {v}", "the applicant, {v}, was admitted", "social security no. {v}", "{v} is what the card says", "patient {v} waits outside"),
    "iban": ("wire the rent to {v}", "{v} is where it should go", "IBAN: {v}", "my account {v} was charged", "send the deposit to {v} please", "bank details {v}"),
    "date": ("born on {v} in Turin", "her birthday, {v}, fell on a Sunday", "birth date {v}", "DOB {v}", "he came into the world (born {v})", "date of birth: {v}", "b-day {v}"),
    "number": ("passport {v}", "licence {v} was shown at the desk", "account number {v}", "taxpayer {v}", "acct {v} is overdrawn", "mobile {v}", "call {v}", "national id {v}", "her patient file {v}", "transfer to {v}", "tel. {v}"),
    "at_mail": ("ask {v} about it", "I am {v} these days", "mail {v}", "questions go to {v}", "signed, {v}", "contact: {v}", "you may write to {v}", "reach us via {v}", "{v} answers within a day", "drop a line to {v}"),
}
ORDINARY = {
    "tel": ("the team won {v} in three sets", "firmware {v} fixes it", "lot {v} was sold", "order {v} has left the house", "some {v} people came", "dial gauge model {v}", "the ratio was {v} overall", "phone model {v} sells well", "page {v}", "invoice {v}", "readings of {v} were noted", "between {v} visitors a year", "item {v} is gone", "serial {v}", "version {v} of the driver", "{v} units were made", "article {v} in the list", "on {v} the shop opened", "ref {v}"),
    "ssn": ("part no {v}", "spare {v} fits the older pump", "order {v}", "item {v} is back", "serial {v}", "ref {v} closed"),
    "iban": ("serial {v}", "build {v}", "part no {v}", "the key {v} unlocks it", "order {v}", "item {v}"),
    "date": ("it opened on {v}", "released {v}", "the storm of {v} did harm", "updated {v}", "version of {v}", "copyright {v}", "we left on {v} by train", "the invoice of {v}", "they met us on {v}", "score of {v}", "as of {v} it is closed", "the contact of {v} was lost"),
    "number": ("about {v} readers", "isbn {v}", "order {v}", "item {v}", "serial {v}", "it took {v} steps", "the file has {v} rows", "invoice {v}", "build {v}", "a score of {v}", "some {v} stars", "{v} copies were sold"),
    "at_mail": ("{w}", "then {w} again", "they {w} now", "and {w} as ever"),
}


def labelled(rows: int, seed: int) -> list[tuple[str, str, int]]:
    """(line, planted value, label): values in sentences of ``PERSONAL`` and the same shapes in those of ``ORDINARY``."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    up = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    name = lambda: rnd.choice("ann bob carla dmitri eva farid grace hiro ines jon".split()) + rnd.choice(["", ".", "_"]) + rnd.choice(["lee", "ortiz", "novak", "kim", "shah", "", "77", "q" * rnd.randint(10, 90)])
    site = lambda: rnd.choice(rnd.choice(["mail", "post", "corp", "site", "uni-x", "bakery", "w" * rnd.randint(10, 90)]).split())
    dates = [lambda: f"{rnd.choice(['19', '20'])}{d(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}", lambda: f"{rnd.randint(10, 28)}/0{rnd.randint(1, 9)}/{rnd.choice(['19', '20'])}{d(2)}", lambda: f"{rnd.randint(1, 9)}.{rnd.randint(1, 12)}.20{d(2)}"]

    def grouped() -> str:
        """A national number in groups of one size behind an area code."""
        size, between = rnd.choice((2, 3, 4)), rnd.choice(" -.  ")
        return rnd.choice("0001") + d(rnd.randint(1, 4)) + "".join(between + d(size) for _ in range(rnd.randint(*{2: (3, 4), 3: (2, 3), 4: (1, 2)}[size])))

    def ten() -> str:
        """Ten digits in three groups, any separator."""
        between = rnd.choice("-. ")
        return f"{d(3)}{between}{d(3)}{between}{d(4)}"

    tel = [
        grouped, grouped, grouped, ten, ten, ten,
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(3)} {d(2)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(2)} {d(2)}",
        lambda: f"0{d(4)} {d(6)}", lambda: f"{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(2)}-{d(4)} {d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"(0{d(4)}) {d(6)}",
    ]
    other = [  # what looks like a telephone number in ordinary use
        *dates, lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{rnd.randint(10, 999)} 000 000", lambda: f"{rnd.randint(10, 30)}.{rnd.randint(10, 99)}.{d(4)}", lambda: f"{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(3)}-{d(3)}-{d(3)}", lambda: f"{rnd.randint(10, 99)} {d(3)} {d(3)}",
        lambda: f"978-{d(2)}-{d(4)}-{d(3)}", lambda: f"19{d(2)}-19{d(2)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}",
    ]
    value = {
        "at_mail": lambda: f"{name()}{rnd.choice([' at ', ' (at) ', '[at]', '(at)', ' [at] ', ' @ '])}{site()}{rnd.choice([' dot ', '(dot)', ' [dot] ', '.'])}{rnd.choice(['', '', '', 'm1.', 'a.b.'])}{rnd.choice('com org net io de'.split())}",
        "tel": lambda: rnd.choice(tel)(),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(2)}" if rnd.random() < 0.5 else f"{up(2)}{d(2)}{d(16)}",
        "date": lambda: rnd.choice(dates)(),
        "number": lambda: d(rnd.randint(7, 18)),
    }
    verbs, nouns = "look stay shop eat meet arrive meetings sale open".split(), "home.Then noon.We site.com shop.example.org once.But school.Later bakery.de".split()
    filler = "lorem ipsum dolor sit amet the quick plan of many words was here today".split()
    word = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    out = []
    for k in range(rows):
        kind = MORE[k % len(MORE)]
        label = int(rnd.random() < 0.55)
        v = value[kind]()
        if not label and kind == "tel" and rnd.random() < 0.95:
            v = rnd.choice(other)()
        if not label and kind == "at_mail":
            v = f"{rnd.choice(verbs)} at {rnd.choice([rnd.choice(nouns), site() + rnd.choice(['.com', '.org', '.de'])])}"
        line = rnd.choice((PERSONAL if label else ORDINARY)[kind]).format(v=v, w=v)
        out.append((f"{word(rnd.randint(0, 6))} {line}{rnd.choice(['', '.', ',', ' ' + word(3)])}", v, label))
    return out


def fit(spark: SparkSession, rows: int = 3600, seed: int = 11, rounds: int = 60, depth: int = 3, rate: float = 0.4, precision: float = 0.95) -> PiiModel:
    """Fit on ``rows`` labelled lines (the documented bound); every third is held out
    for the calibration and the thresholds."""
    lines = labelled(rows, seed)
    data = json.dumps([{"i": i, "t": t, "v": v, "y": y} for i, (t, v, y) in enumerate(lines)])
    got = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(data), "array<struct<i:int,t:string,v:string,y:int>>")).alias("r"))
        .select("r.*", F.explode(candidates(F.col("r.t"))).alias("s"))
        .select("i", "y", F.col("s.kind").alias("kind"), (F.length("v") * 0.8 <= F.length("s.hit")).alias("whole"), features(F.col("s")).alias("f"))
        .collect()
    )
    x = np.array([r["f"] for r in got], float)
    kind = np.array([r["kind"] for r in got])
    own = kind == len(BASE) + np.array([r["i"] for r in got]) % len(MORE)  # a date that also has the form of a telephone number is none
    y = np.array([r["y"] if r["whole"] else 0 for r in got], float) * own
    held = np.array([r["i"] for r in got]) // len(MORE) % 3 == 0
    trees, margin = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], depth)
        trees.append(tree)
        margin = margin + rate * (tree.predict(x) if isinstance(tree, Tree) else tree)
    a, b = platt(margin[held], y[held])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    cut = {}
    for k, name in enumerate(MORE):
        own = held & (kind == len(BASE) + k)
        cut[name] = next((float(c) for c in np.unique(p[own]) if c >= 0.5 and y[own & (p >= c)].mean() >= precision), 1.01)
        cut[name] -= 1e-9
    return PiiModel(tuple(trees), rate, (a, b), cut)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic fit of the outcome on the margin by Newton's method."""
    w, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9 or not math.isfinite(step.sum()):
            break
    return float(w[0]), float(w[1])


def scan(docs: DataFrame, model: PiiModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans``: arrays of ``struct<kind, start, end>``."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    rows = rows.select(*keep, base(F.col("__text")).alias("__base"), F.filter(candidates(F.col("__text")), model.picked).alias("__more"))
    named = lambda c: F.transform(c, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*keep, named(F.col("__base")).alias("base"), named(F.array_sort(F.concat("__base", "__more"))).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first span."""
    t = F.coalesce(text, F.lit(""))
    state = F.struct(F.array().cast("array<struct<a:int,b:int,kind:string>>").alias("runs"), F.lit(-1).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(acc["runs"], F.array(F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))).alias("runs"), s["end"].alias("reach"))
        last = F.element_at(acc["runs"], -1)
        longer = F.struct(
            F.concat(F.slice(acc["runs"], F.lit(1), F.greatest(F.size(acc["runs"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["end"]).alias("b"), last["kind"].alias("kind")))).alias("runs"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        )
        return F.when(s["start"] >= acc["reach"], fresh).otherwise(longer)

    runs = F.aggregate(found, state, step, lambda acc: acc["runs"])
    parts = lambda r: F.concat(
        F.transform(r, lambda x, i: F.concat(F.substring(t, F.when(i == 0, 0).otherwise(F.coalesce(F.get(r, i - 1)["b"], F.lit(0))) + 1, x["a"] - F.when(i == 0, 0).otherwise(F.coalesce(F.get(r, i - 1)["b"], F.lit(0)))), F.lit("["), F.upper(x["kind"]), F.lit("]"))),
        F.array(F.substring(t, F.element_at(r, -1)["b"] + 1, F.length(t))),
    )
    return F.when(text.isNull() | (F.size(found) == 0), text).otherwise(let(runs, lambda r: F.array_join(parts(r), "")))
