"""Personal data by a semi-Markov conditional random field.

A text is a sequence of atoms (words, punctuation marks, white space). A segmentation covers it
with segments: single atoms outside any entity, and entities of up to MOST atoms. Features look
at a whole candidate span: its shape, what parses it, its checksum, the characters at its
borders and the word before it. Training maximises the likelihood of segmentations of made-up
sentences by the semi-Markov forward-backward sums; decoding is the dynamic programme over all
segmentations, which chooses borders and types jointly.

An entity holds a digit, an @ or a known prefix of keys by definition (keys and passwords of
letters alone without such a prefix are none), so decoding runs only over stretches of text within
MOST atoms of such a trigger; elsewhere every segment is outside, at score zero, and the best
segmentation of the text is the best of each stretch.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textquarry.llm.common import map_slices

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
#: Atoms of an entity at most.
MOST = 19
#: Sentences, rounds and seed of the training, which uses no table.
SENTENCES, ROUNDS, SEED = 600, 60, 11

_trigger = re.compile(r"[0-9@]+|A[KS]IA|sk_live_|gh[pousr]_")
_atom = re.compile(r"[^\W_]+|\s|[\W_]")
_possible = {
    "EMAIL": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "PHONE": re.compile(r"[+(]?\d[\d ().-]{5,}\d"),
    "IP": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}"),
    "CARD": re.compile(r"\d(?:[ -]?\d){12,18}"),
    "SECRET": re.compile(r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}|A[KS]IA[A-Z2-7]{16}|sk_live_[A-Za-z]{16,}|gh[pousr]_[A-Za-z]{30,}"),
    "SSN": re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}"),
    "IBAN": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
}
_run_end = re.compile(r"[^\W_]*\Z").search
_long_hex = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def atoms(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _atom.finditer(text)]


def features(text: str, a: int, b: int, kind: str) -> list[str]:
    """Of the whole span text[a:b] as an entity of that kind."""
    span = text[a:b]
    digits = re.sub(r"[^0-9]", "", span)
    before, after = text[a - 1 : a], text[b : b + 1]
    words = re.findall(r"[^\W\d_]+", text[max(0, a - 40) : a])
    out = [
        "bias",
        "digits=" + str(min(len(digits), 20)),
        "before=" + ("edge" if not before or before.isspace() else "word" if before.isalnum() else before if before in "+-.@_/$#" else "mark"),
        "after=" + ("edge" if not after or after.isspace() else "word" if after.isalnum() else after if after in "@_/%-" else "mark"),
        "word=" + (words[-1].lower() if words else ""),
        "shape=" + re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", span)))[:24],
    ]
    if after in ".-" and after and text[b + 1 : b + 2].isalnum():
        out.append("goes on")
    if before in ".-" and before and text[a - 2 : a - 1].isalnum():
        out.append("comes from")
    if kind == "IP":
        out.append("octets=" + str("." in span and all(int(x) < 256 for x in span.split("."))))
    elif kind == "CARD":
        out.append("luhn=" + str(luhn(digits)))
    elif kind == "IBAN":
        out.append("mod97=" + str(mod97(span.replace(" ", ""))))
    elif kind == "SECRET":
        share = len(digits) / len(span)
        out += [f"hex={_long_hex(span) is not None}", f"size={min(len(span) // 8, 6)}", f"distinct={min(len(set(span)), 16)}", f"share={int(share * 4)}"]
    elif kind == "PHONE":
        out += [f"plus={span[0] == '+'}", f"round={'(' in span and ')' in span}", f"groups={min(len(re.findall(r'[0-9]+', span)), 6)}"]
    return [kind + ":" + x for x in out]


def candidates(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first atom, atom after the last, type) of every span that can be an entity: each start and end at atoms' borders, up to MOST atoms, that parses as the type."""
    starts = {a: i for i, (a, _) in enumerate(spans)}
    ends = {b: i + 1 for i, (_, b) in enumerate(spans)}
    for kind, pattern in _possible.items():
        for a, i in starts.items():
            # no further than an entity can go, so that long runs of marks and digits stay linear
            if text[a].isspace() or not (m := pattern.match(text, a, spans[min(i + MOST, len(spans)) - 1][1])):
                continue
            for j in range(i + 1, min(i + MOST, len(spans)) + 1):
                b = spans[j - 1][1]
                if b > m.end():
                    break
                if b in ends and (b == m.end() or pattern.fullmatch(text, a, b)):
                    yield i, j, kind


def _back(text: str, at: int) -> int:
    """Where the atom that ends before text[at] starts."""
    if not text[at - 1].isalnum():
        return at - 1
    step = 32
    while True:
        part = text[max(0, at - step) : at]
        run = len(part) - len(_run_end(part).group())
        if run or step >= at:
            return max(0, at - step) + run
        step *= 4


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Character ranges around triggers, at atoms' borders, MOST atoms wide on both sides: no entity of at most MOST atoms with a trigger in it lies across their borders, however long its words are."""
    lo = hi = -1
    for m in _trigger.finditer(text):
        a, b = m.span()
        if b <= hi and a < solid:
            continue  # in an atom that was looked at
        for n in range(MOST):
            if a <= max(hi, 0):
                break
            a = _back(text, a)
        inside = _atom.match(text, m.end() - 1)
        solid = b = inside.end() if inside else b
        for n in range(MOST - 1):
            if b >= len(text):
                break
            b = _atom.match(text, b).end()
        if a > hi:
            if hi >= 0:
                yield lo, hi
            lo = a
        hi = max(hi, b)
    if hi >= 0:
        yield lo, hi


# --- training ---


def _sentences(rng: random.Random, n: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuéüñ") for _ in range(rng.randint(1, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    plain = "abcdefghijklmnopqrstuvwxyz"

    def card() -> str:
        d = digits(rng.choice((15, 16, 16, 16)))
        if rng.random() < 0.4:
            d = next(d[:-1] + x for x in "0123456789" if luhn(d[:-1] + x))
        return d if rng.random() < 0.6 else rng.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def iban() -> str:
        country, body = rng.choice(("DE", "FR", "ES", "GB", "NL")), digits(rng.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def email() -> str:
        name = "".join(rng.choice(plain) for _ in range(rng.randint(2, 9)))
        name += rng.choice(("", "." + digits(2), "_" + "".join(rng.choice(plain) for _ in range(5)), "+x", digits(3)))
        return f"{name}@{''.join(rng.choice(plain) for _ in range(rng.randint(3, 7)))}{rng.choice(('', digits(1)))}{rng.choice(('', '.example', '.mail'))}.{rng.choice(('com', 'org', 'de', 'net', 'co'))}"

    make = {
        "EMAIL": email,
        "PHONE": lambda: rng.choice((f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{rng.randint(1, 99)}{digits(10)}", f"{digits(3)}.{digits(3)}.{digits(4)}")),
        "IP": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)) if rng.random() < 0.9 else ":".join(hexes(4) for _ in range(8)),
        "CARD": card,
        "SECRET": lambda: rng.choice((hexes(40), hexes(32), hexes(64), "sk_live_" + "".join(rng.choice(plain + plain.upper() + "0123456789") for _ in range(24)), "AKIA" + "".join(rng.choice(plain.upper() + "234567") for _ in range(16)), "ghp_" + "".join(rng.choice(plain + "0123456789") for _ in range(36)))),
        "SSN": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "IBAN": iban,
    }
    other = (
        lambda: str(rng.randint(0, 2100)), lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(0, 23)}:{digits(2)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"${rng.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: f"{rng.randint(1, 100)}%", lambda: digits(rng.randint(5, 9)), lambda: f"{word()}{digits(2)}",
        lambda: f"@{word()}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{digits(2)}.{digits(2)}.{rng.randint(1900, 2030)}", lambda: f"{digits(1)} {digits(3)} {digits(3)}", lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(3)} {digits(4)}",
    )
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(3, 9)):
            draw = rng.random()
            if draw < 0.35:
                kind = rng.choice(TYPES)
                if kind == "SECRET" and rng.random() < 0.6:
                    text += rng.choice(('token = "', "api_key=", "password: ", "secret = '"))
                if kind == "PHONE" and rng.random() < 0.2:
                    text += rng.choice(("tel: ", "call "))
                value = make[kind]()
                gold.append((len(text), len(text) + len(value), kind))
                text += value
            elif draw < 0.6:
                text += rng.choice(other)()
            else:
                text += word()
            text += rng.choice((" ", " ", " ", " ", ", ", ". ", "\n", "*** ", "%%% ", "!! ", '" ', "### ", "&&& ", "$$$ ", " | "))
        yield text, gold


def train(sentences: int = SENTENCES, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, float]:
    """Weights by gradient ascent (Adagrad) on the likelihood, a little pulled to zero; the same at each call."""
    names: dict[str, int] = {}
    data = []
    for text, gold in _sentences(random.Random(seed), sentences):
        spans = atoms(text)
        starts, ends = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
        right = {(starts[a], ends[b], k) for a, b, k in gold}
        by_end: dict[int, list] = defaultdict(list)
        for i, j, k in candidates(text, spans):
            ids = [names.setdefault(f, len(names)) for f in features(text, spans[i][0], spans[j - 1][1], k)]
            by_end[j].append((i, np.array(ids), (i, j, k) in right))
        data.append((len(spans), by_end))
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):
        grad = -0.05 * w
        for n, by_end in data:
            marks = sorted({0, n, *by_end, *(i for c in by_end.values() for i, _, _ in c)})
            place = {m: p for p, m in enumerate(marks)}
            own = [(place[i], place[j], ids, gold, float(w[ids].sum())) for j in sorted(by_end) for i, ids, gold in by_end[j]]
            ahead: list[list] = [[] for _ in marks]
            for c in own:
                ahead[c[1]].append(c)
            alpha = [0.0] * len(marks)
            for p in range(1, len(marks)):
                terms = [alpha[p - 1]] + [alpha[c[0]] + c[4] for c in ahead[p]]
                top = max(terms)
                alpha[p] = top + math.log(sum(math.exp(t - top) for t in terms))
            beta = [-math.inf] * len(marks)
            beta[-1] = 0.0
            for p in range(len(marks) - 1, 0, -1):
                for q, s in [(p - 1, 0.0)] + [(c[0], c[4]) for c in ahead[p]]:
                    x, y = beta[q], beta[p] + s
                    hi, lo = (x, y) if x > y else (y, x)
                    beta[q] = hi + math.log1p(math.exp(lo - hi))
            for i, j, ids, gold, s in own:
                np.add.at(grad, ids, gold - math.exp(alpha[i] + s + beta[j] - alpha[-1]))
        seen += grad * grad
        w += 0.5 * grad / np.sqrt(seen)
    return {f: float(w[i]) for f, i in names.items()}


_trained: dict[tuple, dict[str, float]] = {}


def model(sentences: int = SENTENCES, rounds: int = ROUNDS, seed: int = SEED) -> dict[str, float]:
    """train(), once a process."""
    key = (sentences, rounds, seed)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


# --- decoding ---


def best(text: str, weights: dict[str, float], lo: int = 0, hi: int | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of the entities in the best segmentation of text[lo:hi]; features may look beyond it. Of equal scores, up to each place, the segmentation that leaves the last atom outside wins, then the one whose last entity was found first: by type in the order of _possible, then by the earlier start."""
    hi = len(text) if hi is None else hi
    spans = [m.span() for m in _atom.finditer(text, lo, hi)]
    by_end: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
    for i, j, k in candidates(text, spans):
        s = sum(weights.get(f, 0.0) for f in features(text, spans[i][0], spans[j - 1][1], k))
        if s > 0:
            by_end[j].append((i, k, s))
    score, back = [0.0] * (len(spans) + 1), [None] * (len(spans) + 1)
    for j in range(1, len(spans) + 1):
        score[j] = score[j - 1]
        for i, k, s in by_end.get(j, ()):
            if score[i] + s > score[j]:
                score[j], back[j] = score[i] + s, (i, k, s)
    out, j = [], len(spans)
    while j:
        if back[j]:
            i, k, s = back[j]
            out.append((spans[i][0], spans[j - 1][1], k, s))
            j = i
        else:
            j -= 1
    return out[::-1]


def entities(text: str, weights: dict[str, float]) -> list[tuple[int, int, str, float]]:
    return [x for lo, hi in stretches(text) for x in best(text, weights, lo, hi)]


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, start, end, kind, score): a row for each entity; start and end count characters from 0.

    Null and empty texts and texts without entities have no row; an empty table gives an empty
    one. A repeated row is reported as often as it occurs, a null id stays null. Whole texts
    are searched, at any length of texts and of words. Of segmentations of equal score the one
    that best() names wins. Other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model() if weights is None else weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for x in entities(text, shared.value) if text else ():
                at.append(i)
                rows.append(x)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "start", "end", "kind", "score"])

    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, start int, end int, kind string, score double")


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs with each entity in text replaced by its type in brackets, and n_chars, where there is such a column, by the new length of changed texts. All rows and other columns stay as they are; null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model() if weights is None else weights)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        found = entities(text, shared.value) if text else ()
        for a, b, kind, _ in reversed(found):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        return text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([clean(t) for t in batch.column("text").to_pylist()], pa.string())
        columns = {n: batch.column(n) for n in names} | {"text": texts}
        if "n_chars" in columns:
            kind = columns["n_chars"].type
            changed = pc.not_equal(texts, batch.column("text")).fill_null(False)
            columns["n_chars"] = pc.if_else(changed, pc.utf8_length(texts).cast(kind), columns["n_chars"])
        return pa.RecordBatch.from_pydict(columns)

    return map_slices(docs, run, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))
