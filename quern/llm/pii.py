"""Personal data: base patterns, and candidates judged by boosted trees.

Generators of high recall propose overlapping spans that the base patterns don't
cover: written-out e-mail addresses, IPv6 and masked IPv4 addresses, card numbers
with other separators, telephone numbers without ``+``, and secrets (passwords,
keys, tokens; a kind of the method's own). Boosted trees score each from its
format and its context; a threshold for each kind, calibrated on held-out cases
for a precision of PRECISION, selects; of overlapping selected spans the best
stays. Base spans always stay.

There are no labels for spans, so the trees are trained on cases made here from a
fixed seed: formats and look-alikes set into sentences of four languages. A cue
word stands before true and false cases alike, so that it can't decide alone.

The model is trained once, on the driver, and broadcast. Texts are judged whole,
batch by batch; nothing shuffles.
"""

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.boosting import BoostedTrees, Isotonic

KINDS = ("email", "ip", "card", "phone")  # of the base patterns
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.98
CONTEXT = 32
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits that it could start before; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind as listed, then start. Linear in the text.

    An address is found from its ``@``: the local part is the run of its
    characters before, back to the last match's end.
    """
    out: list[Span] = []
    done = gap = 0
    at = text.find("@")
    while at >= 0:
        lower = max(done, gap)
        if at > lower and (m := _DOMAIN.match(text, at + 1)):
            start = lower + len(text[lower:at].rstrip(_LOCAL))
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        gap = at + 1
        at = text.find("@", max(gap, done))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


#: Fixed values. The generators of further candidates.
GENERATORS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) | ?@ ?)[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) | ?\. ?)[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\[?\.\]? ?[0-9]{1,3}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,80}[0-9])[A-Za-z0-9+/_-]{20,200}(?![A-Za-z0-9+/_-])={0,2}")),
]
#: Fixed values. Words whose nearness speaks for or against a kind.
CUES = {
    "email": "mail email e-mail contact write courriel correo kontakt address",
    "ip": "ip host server address addr from client login adresse",
    "card": "card visa mastercard amex credit pay cc karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone",
    "secret": "password passwd passwort pwd pass secret token key apikey api_key auth authorization bearer credential credentials",
    "not": "version order invoice isbn id total price page ref section build time date room number article commit revision sha sha1 sha256 md5 checksum hash digest etag uuid blob",
}
_CUES = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, v.split())) + r")(?![^\W_])") for k, v in CUES.items()}
_TRIGGER = re.compile(r"[0-9:@=]| (?:at|AT) |[\[({] ?(?:at|AT)")
_ASSIGNED = re.compile(r"(?:=>|[=:])[ \t]*(?:[Bb]earer |[Bb]asic )?(?:\"([^\"\s]{4,200})\"|'([^'\s]{4,200})'|([^\s\"'<>,;]{4,200}))")
_NAMED = re.compile(r"[A-Za-z_-]\w*[\"']?[ \t]?$")
#: Fixed values. Beginnings that issuers give their keys.
_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[-_]|pk[-_]|xox[abp]-|AIza|ya29\.|eyJ|glpat-)")
_TLD = re.compile(r"(?<![^\W_])(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|ch|at|us|ca)$", re.IGNORECASE)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Proposed spans, which may overlap each other but no base span."""
    out = []
    if not _TRIGGER.search(text):
        return out
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []

    def propose(kind: str, s: int, e: int) -> None:
        k = bisect.bisect_left(starts, e)  # base spans that start before its end
        if not k or ends[k - 1] <= s:
            out.append((kind, s, e))

    for kind, pattern in GENERATORS:
        for m in pattern.finditer(text):
            propose(kind, *m.span())
    for m in _ASSIGNED.finditer(text):  # the value of anything that is set, if a name stands before
        if _NAMED.search(text, max(0, m.start() - CONTEXT), m.start()):
            propose("secret", *m.span(m.lastindex))
    return list(dict.fromkeys(out))


def _entropy(s: str) -> float:
    """Bits a character, by the string's own counts."""
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def span_features(text: str, span: Span) -> list[float]:
    kind, s, e = span
    body, before, after = text[s:e], text[max(0, s - CONTEXT) : s].lower(), text[e : e + CONTEXT].lower()
    digits = _digits(body)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", body) if g]
    near = before + " | " + after
    marked = bool(re.search(r"[\[({] ?(?:at|dot|@|\.) ?[\])}]|(?:dot|DOT)", body))
    parts = [int(x) for x in re.findall(r"[0-9]{1,3}", body)]
    letters = re.findall(r"[A-Za-z]+", body)
    classes = sum(bool(re.search(c, body)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\sA-Za-z0-9]"))
    named = re.search(r"([\w-]*)[\"']?\s*(?:=>|[=:])\s*(?:bearer |basic )?[\"']?$", before)  # what the span is set to
    return [
        *[float(kind == k) for k in ALL_KINDS], float(len(body)), float(len(digits)), len(digits) / len(body), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(set(groups)) == 1), float(luhn(digits)) if digits else 0.0, float(bool(parts) and max(parts) <= 255), float(marked), float("(" in body), float(body.count(":")), float(body.count(".")), float(body.count("/")), float(body.startswith("00")),
        *[float(bool(_CUES[k].search(before))) for k in (*ALL_KINDS, "not")], float(bool(_CUES[kind].search(near))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.search(r"[$€£%#=]\s*$", before))),
        float(bool(re.search(r"[a-f]", body.lower())) and kind == "ip"), float(body.lower() != body),
        _entropy(body), float(classes), float(max(map(len, letters), default=0)), float(bool(re.fullmatch(r"[0-9A-Fa-f]+", body))), float(bool(_PREFIX.match(body))), float(bool(named)), float(bool(named and _CUES["secret"].search(named[1]))),
        float(bool(named and _CUES["not"].search(named[1]))), float(bool(_TLD.search(body))), float(". " in body), float(bool(re.search(r"\. [A-Z]", body))), float("@" in body), float(bool(re.search(r"[0-9._-]", body.split(" ")[0]))), sum(x in "aeiou" for x in body.lower()) / len(body),
    ]


#: Fixed values. Sentences that cases are set into.
SENTENCES = """The committee met again on Tuesday and agreed on a plan.|Please read the notes before you come to the meeting.|We looked at the house. Then it began to rain.|Nobody at the station knew when the train would leave.|The new version was built in May and costs less than the old one.
She wrote three letters and never got an answer.|Results are given in table four of the report.|He called the office from the airport.|Der Ausschuss tagte am Dienstag und beschloss einen Plan.|Bitte lesen Sie die Hinweise vor der Sitzung.|Das Haus steht am Ende der Straße.|Niemand am Bahnhof wusste, wann der Zug fährt.
Le comité s'est réuni mardi et a adopté un projet.|Veuillez lire les notes avant la réunion.|La maison se trouve au bout de la rue.|Personne à la gare ne connaissait l'heure du départ.|El comité se reunió el martes y aprobó un plan.|Lea las notas antes de la reunión, por favor.|La casa está al final de la calle.|Nadie en la estación sabía a qué hora salía el tren."""
#: Fixed values. Words that stand where a value would.
PLAIN_VALUES = "required optional expired invalid missing hidden default unknown disabled enabled unchanged refreshed rotated forgotten placeholder something yes none null string boolean session handler manager".split()


def _cases(seed: int = 11, n: int = 9000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kinds) of the candidates of made-up cases."""
    r = random.Random(seed)
    sentences = SENTENCES.replace("\n", "|").split("|")
    word = lambda: "".join(r.choice("aeiounrstlmd") for _ in range(r.randint(2, 8)))
    pick = lambda chars, low, high: "".join(r.choice(chars) for _ in range(r.randint(low, high)))
    num = lambda k: pick("0123456789", k, k)
    hexa = lambda k: pick("0123456789abcdef", k, k)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = r.choice("3456") + num(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def compressed() -> str:
        sides = [":".join("%x" % r.randrange(1, 16 ** r.randint(1, 4)) for _ in range(r.randint(0, 3))) for _ in range(2)]
        return "::".join(sides) if any(sides) else "::1"

    def name() -> str:
        return pick("abcdef", 1, 4)

    def domain(dot: str) -> str:
        return dot.join([word(), *([word()] if r.random() < 0.3 else []), r.choice("com org net de fr es co.uk edu io".replace(".", dot).split())])

    def email(good: bool) -> str:
        if good:
            at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" (at) ", "."), ("[at]", "."), (" AT ", " DOT "), (" @ ", " . "), ("{at}", ".")])
            return r.choice([word(), f"{word()}{num(2)}", f"{word()}.{word()}", f"{word()}_{word()}"]) + at + domain(dot)
        return r.choice([f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}. {r.choice('It Es De At Us In Io A I The'.split())}", f"{word()} at {word()}. {r.choice('it es de at us in'.split())}", f"{word()} at {num(1)}.{num(2)}", f"{word()} at {word()} dot {word()}", f"{word()} at {word()}. {word()}", f"{word()} @ {num(2)}.{num(2)}"])

    def ip(good: bool) -> str:
        if good:
            u = r.random()
            return ":".join("%x" % r.randrange(1, 65536) for _ in range(8)) if u < 0.4 else compressed() if u < 0.7 else "[.]".join(str(r.randrange(256)) for _ in range(4))
        return r.choice([f"{name()}::{name()}", f"::{name()}", ":".join(num(2) for _ in range(3)), f"{num(1)} . {num(1)} . {num(2)} . {num(3)}", ":".join(num(2) for _ in range(4)), ":".join(hexa(2) for _ in range(6)), f"{num(1)}:{num(2)}:{num(2)}"])

    def cards(good: bool) -> str:
        if good:
            c, sep = card(), r.choice([".", "  ", " - ", "/", "_"])
            return sep.join(c[i : i + 4] for i in range(0, 16, 4))
        return r.choice(["/".join([num(4), num(4), num(4)]), ".".join([num(4), num(4), num(4), num(4)]), f"{num(4)} - {num(4)} - {num(4)}", f"{num(4)}_{num(3)}_{num(3)}", "/".join([num(4), num(4), num(4), num(4)])])

    def phone(good: bool) -> str:
        if good:
            return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0049 {num(3)} {num(4)}{num(3)}", f"0{num(3)} {num(3)}{num(4)}", f"0{r.randint(1, 9)} " + " ".join(num(2) for _ in range(4)), f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)}/{num(3)}{num(4)}"])
        return r.choice([f"{num(4)}-{num(3)}-{num(4)}", f"{num(2)}/{num(3)}/{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}.{num(3)}", f"97{r.choice('89')}-{num(3)}-{num(4)}", f"{num(2)} {num(3)} {num(3)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"])

    def secret(good: bool) -> str:
        """With the name it is set to, where it has one."""
        key = r.choice(["password", "passwd", "Password", "PASSWORD", "pwd", "secret", "token", "TOKEN", "api_key", "apikey", "auth_token", "access_key", "client_secret", "key", "Authorization"])
        quote = r.choice(['"', "'", "", ""])
        sep = r.choice(["=", " = ", ": ", ":", " => "])
        if good:
            value = r.choice([hexa(r.choice([12, 16, 18, 24, 32, 40, 64])), hexa(r.choice([20, 32, 40])).upper(), pick(alnum, 16, 44), pick(alnum + "!$%&*#?", 8, 20) + num(1), f"{word().title()}{num(r.randint(2, 4))}{r.choice('!$#?')}", pick(alnum + "+/", 30, 60) + "=="])
            if r.random() < 0.2:
                return r.choice(["AKIA" + pick(alnum, 16, 16).upper(), "ghp_" + pick(alnum, 36, 36), "sk-" + pick(alnum, 32, 48), "eyJ" + pick(alnum, 60, 120)])
            return f"{key}{sep}{quote}{value}{quote}"
        u = r.random()
        if u < 0.35:  # a secret's name before a word
            return f"{key}{sep}{quote}{r.choice([r.choice(PLAIN_VALUES), word() + word(), r.choice(PLAIN_VALUES) + '_' + r.choice(PLAIN_VALUES), '${' + key + '}'])}{quote}"
        if u < 0.6:  # a secret's form under another name
            other = r.choice(["commit", "sha1", "sha256", "md5", "checksum", "etag", "uuid", "digest", "blob", "id", "ref", "build", "color", "file"])
            value = r.choice([hexa(r.choice([8, 16, 32, 40, 64])), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", pick(alnum, 20, 30)])
            return f"{other}{r.choice([sep, ' ', ' '])}{quote}{value}{quote}"
        if u < 0.8:  # any name, any word
            return f"{word()}{sep}{quote}{r.choice([word() + word(), num(r.randint(4, 9)), f'{num(2)}:{num(2)}', word() + num(2)])}{quote}"
        return r.choice(["_".join([word() for _ in range(4)]) + num(1), hexa(40), f"{word()}/{word()}/{word()}/{num(4)}/{word()}-{num(2)}", f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", "-".join([word(), word(), word(), num(4), num(2)])])

    make = {"email": email, "ip": ip, "card": cards, "phone": phone, "secret": secret}
    x, y, kinds = [], [], []
    for i in range(n):
        kind, good = ALL_KINDS[i % len(ALL_KINDS)], r.random() < 0.5
        body = make[kind](good)
        cue = ""
        if kind != "secret" and r.random() < 0.6:
            # True cases mostly have their own cue and false ones another's, but either may have the other.
            cue = r.choice(CUES[kind if good == (r.random() < 0.85) else "not"].split()) + r.choice([" ", ": ", " "])
        before = r.choice(["", r.choice(sentences) + " ", r.choice(sentences).rstrip(".") + " ", r.choice(sentences) + "\n", f"{word()} {word()} "])
        after = r.choice(["", " " + r.choice(sentences), ". " + r.choice(sentences), "\n" + r.choice(sentences), f" {word()} {word()}", ",", " | "])
        text = before + cue + body + after
        if r.random() < 0.08:
            text = text.upper()
        here = range(len(before + cue), len(before + cue + body) + 1)
        for span in candidates(text, base_spans(text)):
            said = text[span[1] : span[2]]
            value = re.split(r"(?:=>|[=:])\s*", body, maxsplit=1)[-1].strip("\"'") if kind == "secret" else body
            truly = good and span[0] == kind and span[1] in here and said.strip().lower() == value.strip().lower()
            x.append(span_features(text, span)), y.append(float(truly)), kinds.append(ALL_KINDS.index(span[0]))
    return np.array(x), np.array(y), np.array(kinds)


class PiiModel:
    def __init__(self):
        x, y, kinds = _cases()
        check = np.arange(len(y)) % 4 == 3
        self.trees = BoostedTrees(rounds=60, depth=5).fit(x[~check], y[~check])
        raw = self.trees.raw(x[check])
        self.calibration = Isotonic().fit(raw, y[check])
        p = self.calibration(raw)
        self.threshold, self.report = [], {}
        for k, kind in enumerate(ALL_KINDS):
            of = kinds[check] == k
            best = 1.01  # none unless some threshold is precise enough
            for t in np.unique(p[of])[::-1]:
                chosen = of & (p >= t)
                if y[check][chosen].mean() < PRECISION:
                    break
                best = float(t)
            self.threshold.append(max(best, 0.5))
            chosen = of & (p >= self.threshold[-1])
            self.report[kind] = {"candidates": int(of.sum()), "true": int(y[check][of].sum()), "selected": int(chosen.sum()), "right": int(y[check][chosen].sum())}

    def select(self, text: str, base: list[Span]) -> list[Span]:
        found = candidates(text, base)
        if not found:
            return []
        p = self.calibration(self.trees.raw(np.array([span_features(text, s) for s in found])))
        chosen = sorted(((-q, s) for q, s in zip(p.tolist(), found, strict=True) if q >= self.threshold[ALL_KINDS.index(s[0])]), key=lambda x: (x[0], x[1][1] - x[1][2], x[1][1]))
        kept: list[Span] = []
        starts: list[int] = []
        for _, s in chosen:
            i = bisect.bisect_left(starts, s[1])
            if (i and kept[i - 1][2] > s[1]) or (i < len(kept) and kept[i][1] < s[2]):
                continue
            starts.insert(i, s[1])
            kept.insert(i, s)
        return kept


@cache
def model() -> PiiModel:
    """Trained once, from a fixed seed."""
    return PiiModel()


def _write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ALL_KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Positions are code points, ends exclusive. Null counts as empty; an empty text
    has no spans. Repeated rows each give a row, null ids too. An empty table
    gives an empty result; other columns are not read and may have any name.
    Counts are of base spans; ``spans`` has those of the model too, n_added of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())  # some hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = base + judge.select(text, base)
                counts = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
                rows.append({"doc_id": name.as_py(), **counts, "base_sha256": hashlib.sha256(_write(base).encode()).hexdigest(), "spans": _write(spans), "n_added": len(spans) - len(base)})
            kinds = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    base = base_spans(text)
    out, at = [], 0
    for kind, s, e in sorted(base + model().select(text, base), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])
