"""Personal data: exact base patterns, and a linear-chain conditional random field over word-shape features that adds spans.

The field is trained from a small labelled table (``labelled_table``): lines written and marked by hand (pii_labels.txt), which
count several times, and synthetic ones made by rules and a seed. They hold what the base patterns can't say, that is secrets
and keys (a fifth kind), phones without country code and spelled-out addresses, beside look-alikes without a span (versions,
dates, prices, hashes, digests, UUIDs, ranges, order numbers, failing cards and addresses, tables of numbers). Words without a digit, ``@``, ``=`` or a long run of capitals, and not part of a spelled-out address, are fixed to
the outside state, so a text falls into runs of candidate words; Viterbi decodes them in numpy batches of runs of like
length, and a long run in slices with its scores carried over: the result is the exact best path of the whole text.

Edge cases: null and empty texts have no spans; texts, words and runs of any length are read whole; repeated rows are
scanned one by one; an empty table gives no rows; without labelled rows the field adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import pkgutil
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # the first kinds have base patterns
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost non-overlapping per kind, by start and then kind."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:  # the local part is the run of its characters before the sign, back to the last match's end
        start = at
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if re.search(r"[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ------------------------------------------------------------------ the field
#: States: outside, then begin and inside of each kind.
STATES = 1 + 2 * len(KINDS)
_CANDIDATE = re.compile(r"[0-9@=]|[A-Z]{12}")
_WORD = re.compile(r"[^\x20\x09-\x0D]*")
_DOT = re.compile(r"(?<=[\x20\x09-\x0D])[\[(]?dot[\])]?(?=[\x20\x09-\x0D])", re.I)
_NEXT = re.compile(r"[^\x20\x09-\x0D]+")
_AT = re.compile(r"[\[(]?at[\])]?", re.I)
_SPACE = "\x20\t\n\x0b\x0c\r"
_LONG = re.compile(r"[A-Za-z0-9+/_.-]{12,}")
#: Words whose presence before or inside a candidate is a feature, by what they speak of; others are known by their shape alone.
CUE_CLASSES = {
    "secret": ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "auth", "bearer", "credential"),
    "phone": ("call", "phone", "telefon", "tel", "fax", "mobile", "cell", "ring", "whatsapp", "contact"),
    "address": ("mail", "email", "at", "dot", "com", "org", "net", "edu"),
    "hash": ("commit", "revision", "sha", "md", "digest", "hash", "checksum", "etag", "tree", "uuid", "id", "build"),
    "number": ("version", "license", "page", "range", "total", "invoice", "order", "number", "part", "isbn", "serial", "lot", "table", "score", "count"),
    "plain": ("the", "of", "a"),
}
CUE_CLASS = {cue: name for name, cues in CUE_CLASSES.items() for cue in cues}
CUES = tuple(CUE_CLASS)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SLICE = 4096  # words of a run scored at once


def shape(word: str) -> str:
    """A word's shape: letter runs as a or A, digits as 9 with run lengths up to 9, other characters as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 9)}", s)


def _cue(word: str) -> str:
    core = re.sub(r"[^a-z]", "", word.lower())
    return next((c for c in CUES if core == c or (len(c) > 3 and core.endswith(c))), "")


def features(words: list[str], i: int, before: tuple[str, ...] = ()) -> list[str]:
    """Word-shape features of one word of a candidate run. ``before``: the two words ahead of the run."""
    w = words[i]
    digits, form = _digits(w), shape(w)
    out = [f"s={form}", f"p={form[:3]}", f"e={form[-3:]}", f"n={min(len(digits), 20)}", f"at={w.count('@') == 1}", f"dots={min(w.count('.'), 5)}", f"plus={w.startswith('+')}"]
    if w.count("@") == 1:
        out.append(f"dot_after_at={'.' in w.split('@')[1].strip('.,;:')}")
    core = w.strip(".,;:()[]!?\"'|*%$#&")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        out.append(f"octets={_octets(core)}")
    if 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9-]+", core):
        out.append(f"luhn={luhn(digits)}")
    name, sign, value = core.rpartition("=") if "=" in core else core.rpartition(":")
    value = value.strip("\"'")
    if sign:
        out.append(f"name={_cue(name)}:{len(value) >= 8}")
    out.append(f"uuid={bool(_UUID.fullmatch(value))}")
    if len(words) <= 8:  # a short run of numbers as a whole: how many digits, and whether it starts with a zero
        out.append(f"run={len(words)}:{min(sum(len(_digits(x)) for x in words), 20)}:{words[0].lstrip('(')[:1] == '0'}")
    if _LONG.fullmatch(value):
        kind = "hex" if re.fullmatch(r"[0-9a-f]+", value) else "digits" if not re.search(r"[A-Za-z]", value) else "capitals" if re.fullmatch(r"[A-Z0-9]+", value) else "mixed"
        turns = len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", value))
        out += [f"long={kind}:{min(len(value) // 8, 5)}", f"turns={kind}:{min(turns, 6)}", f"head={value[:4] if value[:4] in ('AKIA', 'ASIA', 'ghp_', 'sk-l', 'xoxb') else ''}"]
    ahead = [*before, *words[max(0, i - 2) : i]][-2:]
    out += [f"c1={_cue(ahead[-1]) if ahead else ''}", f"c2={_cue(ahead[-2]) if len(ahead) > 1 else ''}:{(ahead[-1] in ('=', ':', 'is', 'to')) if ahead else ''}", f"own={_cue(w)}"]
    said = next((c for x in (name if sign else "", *ahead[::-1], *before[::-1]) if (c := CUE_CLASS.get(_cue(x))) and c != "plain"), "none")
    made = "hash" if re.fullmatch(r"[0-9a-f]{20,}", value) else "digits" if not re.search(r"[A-Za-z]", value) else "both" if re.search(r"[0-9]", value) else "letters"
    out += [f"said={said}:{made}", f"said={said}:{made}:{min(len(digits), 16)}", f"said={said}:{bool(sign)}:{min(len(value) // 3, 4)}:{made}"]
    for d, side in ((-1, "l"), (1, "r")):
        out.append(f"{side}={shape(words[i + d])}" if 0 <= i + d < len(words) else f"{side}=")
    return out


def _word_ahead(text: str, at: int) -> tuple[int, int] | None:
    """(start, end) of the last word before a place, however long it is."""
    end = len(text[max(0, at - 64) : at].rstrip(_SPACE)) + max(0, at - 64)
    while end and text[end - 1] in _SPACE:
        end -= 1
    start = max(text.rfind(c, 0, end) for c in _SPACE) + 1 if end - 64 > 0 and not any(c in _SPACE for c in text[end - 64 : end]) else end - len(re.split(r"[\x20\x09-\x0D]", text[max(0, end - 64) : end])[-1])
    return (start, end) if start < end else None


def _places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidate words, in order."""
    found: list[tuple[int, int]] = []
    end = -1
    for m in _CANDIDATE.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > max(end, 0) and text[start - 1] not in _SPACE:
            start -= 1
        end = _WORD.match(text, m.start()).end()
        found.append((start, end))
    spelled = set()
    for m in _DOT.finditer(text):  # name at host dot name, each sign by itself
        host = _word_ahead(text, m.start())
        after = _NEXT.search(text, m.end())
        sign = _word_ahead(text, host[0]) if host and after else None
        name = _word_ahead(text, sign[0]) if sign and sign[1] - sign[0] <= 4 and _AT.fullmatch(text[sign[0] : sign[1]]) else None
        if name:
            spelled |= {name, sign, host, m.span(), after.span()}
        elif after and host in spelled:
            spelled |= {m.span(), after.span()}
    return sorted({*found, *spelled}) if spelled else found


def candidate_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring candidate words, as (start, end) places."""
    runs: list[list[tuple[int, int]]] = []
    prior = -1
    for start, end in _places(text):
        if start < prior:  # part of the word before
            continue
        if prior >= 0 and text[prior:start].strip(_SPACE) == "":
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        prior = end
    return runs


def words_before(text: str, at: int) -> tuple[str, ...]:
    """The two words ahead of a place, as far as 80 characters reach (they are context, never part of a span)."""
    return tuple(text[max(0, at - 80) : at].split()[-2:])


class Field:
    """Weights of the chain: emission rows by feature name, and transitions (with a start and an end row)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray) -> None:
        self.index, self.emit, self.trans = index, emit, trans

    def scores(self, words: list[str], before: tuple[str, ...] = (), lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Emission scores of the words lo..hi of a run."""
        hi = len(words) if hi is None else hi
        out = np.zeros((hi - lo, STATES))
        for i in range(lo, hi):
            at = [j for f in features(words, i, before) if (j := self.index.get(f)) is not None]
            if at:
                out[i - lo] = self.emit[at].sum(0)
        return out

    def decode_long(self, words: list[str], before: tuple[str, ...] = ()) -> np.ndarray:
        """Viterbi of one run of any length: slices of emissions, the best scores carried from slice to slice."""
        back = np.zeros((len(words), STATES), np.int8)
        best = self.trans[STATES]
        for lo in range(0, len(words), SLICE):
            e = self.scores(words, before, lo, min(len(words), lo + SLICE))
            for t in range(len(e)):
                if lo + t:
                    step = best[:, None] + self.trans[:STATES]
                    back[lo + t] = step.argmax(0)
                    best = step.max(0) + e[t]
                else:
                    best = best + e[0]
        path = np.zeros(len(words), np.int64)
        path[-1] = int((best + self.trans[STATES + 1]).argmax())
        for t in range(len(words) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def decode(self, batch: list[list[str]], before: list[tuple[str, ...]] | None = None) -> list[np.ndarray]:
        """Viterbi over a batch of runs at once: runs are padded to one length and masked."""
        if not batch:
            return []
        before = before or [()] * len(batch)
        n, most = len(batch), max(map(len, batch))
        if n == 1 or n * most > 64 * SLICE:
            return [self.decode_long(*x) for x in zip(batch, before)]
        e = np.zeros((n, most, STATES))
        length = np.array([len(b) for b in batch])
        for k, words in enumerate(batch):
            e[k, : len(words)] = self.scores(words, before[k])
        best = e[:, 0] + self.trans[STATES][None]
        back = np.zeros((n, most, STATES), np.int8)
        for t in range(1, most):
            step = best[:, :, None] + self.trans[None, :STATES]
            back[:, t] = step.argmax(1)
            live = (t < length)[:, None]
            best = np.where(live, step.max(1) + e[:, t], best)
        state = (best + self.trans[STATES + 1][None]).argmax(1)
        paths = np.zeros((n, most), np.int64)
        rows = np.arange(n)
        for t in range(most - 1, -1, -1):
            paths[:, t] = state
            if t:
                state = np.where(t < length, back[rows, t, state], state)
        return [p[:m] for p, m in zip(paths, length)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(examples: list[tuple[list[str], tuple[str, ...], list[int]]], rounds: int = 50, rate: float = 0.4, penalty: float = 1e-3) -> Field:
    """Maximum-likelihood weights by batch gradients (forward-backward over all runs of one length at once, AdaGrad)."""
    index: dict[str, int] = {}
    groups: dict[int, list] = {}
    for words, before, tags in examples:
        ids = [[index.setdefault(f, len(index)) for f in features(words, i, before)] for i in range(len(words))]
        groups.setdefault(len(words), []).append((ids, tags))
    emit, trans = np.zeros((max(len(index), 1), STATES)), np.zeros((STATES + 2, STATES))
    for s in range(STATES):  # inside follows its own begin or inside only; no run starts inside
        if s and s % 2 == 0:
            trans[STATES, s] = -1e3
            trans[[p for p in range(STATES) if p not in (s, s - 1)], s] = -1e3
    free = trans > -1e3
    ge, gt = np.full_like(emit, 1e-8), np.full_like(trans, 1e-8)
    packed = []
    for length, rows in sorted(groups.items()):
        flat = [(k * length + t, j) for k, (ids, _) in enumerate(rows) for t, fs in enumerate(ids) for j in fs]
        packed.append((length, len(rows), np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), np.array([tags for _, tags in rows])))
    total = max(1, len(examples))
    for _ in range(rounds):
        de, dt = -penalty * emit, np.zeros_like(trans)
        for length, n, where, which, tags in packed:
            e = np.zeros((n * length, STATES))
            np.add.at(e, where, emit[which])
            e = e.reshape(n, length, STATES)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + trans[STATES]
            for t in range(1, length):
                a[:, t] = e[:, t] + _logsum(a[:, t - 1][:, :, None] + trans[None, :STATES], 1)
            b[:, -1] = trans[STATES + 1]
            for t in range(length - 2, -1, -1):
                b[:, t] = _logsum(trans[None, :STATES] + (e[:, t + 1] + b[:, t + 1])[:, None], 2)
            z = _logsum(a[:, -1] + trans[STATES + 1], 1)
            gap = -np.exp(a + b - z[:, None, None])
            np.put_along_axis(gap, tags[:, :, None], np.take_along_axis(gap, tags[:, :, None], 2) + 1, 2)
            np.add.at(de, which, gap.reshape(n * length, STATES)[where] / total)
            for t in range(1, length):
                pair = np.exp(a[:, t - 1][:, :, None] + trans[None, :STATES] + (e[:, t] + b[:, t])[:, None] - z[:, None, None])
                dt[:STATES] -= pair.sum(0) / total
                np.add.at(dt, (tags[:, t - 1], tags[:, t]), 1 / total)
            dt[STATES] += gap[:, 0].sum(0) / total
            dt[STATES + 1] += gap[:, -1].sum(0) / total
        ge += de**2
        gt += dt**2
        emit += rate * de / np.sqrt(ge)
        trans = np.where(free, trans + rate * dt / np.sqrt(gt), trans)
    return Field(index, emit, trans)


def tag_run(text: str, run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """States of a run's words under the given spans."""
    tags = []
    for a, b in run:
        hit = next(((s, k, e) for s, k, e in spans if s < b and a < e), None)
        tags.append(0 if hit is None else 2 * hit[1] + (1 if a <= hit[0] else 2))
    return [2 * ((t - 1) // 2) + 1 if t and t % 2 == 0 and (i == 0 or (tags[i - 1] + 1) // 2 != t // 2) else t for i, t in enumerate(tags)]


def _row(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A synthetic line and its spans (start, kind, end)."""
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    chars = lambda n, of: "".join(pick(of) for _ in range(n))
    hexa, mixed, capitals = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: chars(rng.randint(2, 9), "etaoinshrdlucmfwypvbgk")
    prose = lambda n: " ".join(word() for _ in range(n))

    def secret() -> tuple[str, str, str]:
        name = pick(["token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "auth_token", "pwd", "client_secret", "key", "credential"])
        name = pick([name, name.upper(), name.capitalize()])
        value = pick([chars(pick([16, 18, 20, 24, 32, 40, 64]), hexa), chars(rng.randint(16, 44), mixed), chars(20, capitals)])
        return pick([
            (f'{name} = "', value, '"'), (f"{name}=", value, ""), (f"{name}: ", value, ""), (f"{name}='", value, "'"), (f"{name} is ", value, pick(["", "."])), ("Bearer ", value, ""),
            ("", "AKIA" + chars(16, capitals), pick(["", "."])), ("", "ghp_" + chars(36, mixed), ""), ("", "sk-live" + chars(32, mixed), ""),
        ])

    def phone() -> tuple[str, str, str]:
        a, b, c = digits(3), digits(3), digits(4)
        lead = pick(["", "", "call ", "phone ", "tel: ", "fax ", "mobile: "])
        return lead, pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+44 {digits(2)} {c} {c}", f"00{digits(2)} {a} {digits(6)}"]), pick(["", ".", ","])

    def address() -> tuple[str, str, str]:
        at, dot = pick([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT")])
        plain = f"{word()}{pick(['', '.', digits(2)])}{word()}@{word()}.{pick(['com', 'org', 'example.com'])}"
        return pick(["", "mail ", "contact "]), pick([plain, f"{word()} {at} {word()} {dot} {pick(['com', 'org', 'net'])}"]), pick(["", "."])

    def card() -> tuple[str, str, str]:
        d = digits(15)
        d += next(x for x in "0123456789" if luhn(d + x))
        return "", pick([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"]), ""

    def other() -> str:
        n, d = rng.randint(1, 2030), digits(16)
        if luhn(d):
            d = d[:-1] + str((int(d[-1]) + 1) % 10)
        return pick([
            f"version {n % 20}.", f"v{n % 9}.{n % 7}.{n % 5}", f"CC BY-NC {n % 5}.0.", f"version {n % 9}.{n % 9}", f"in {1900 + n % 130},", f"{1900 + n % 99}-{1950 + n % 99}", f"2024-0{1 + n % 9}-1{n % 9}", f"1{n % 9}/05/2021", f"{n % 24}:{10 + n % 50}", f"${n}.50", f"{1 + n % 9},{100 + n % 900},{100 + n % 900}",
            f"page {n % 400}", f"({n % 30})", d, f"{300 + n % 600}.{n % 999}.{n}.{n % 300}", f"commit {chars(pick([7, 40]), hexa)}", f"{pick(['sha256', 'digest', 'hash', 'checksum', 'etag', 'md5', 'revision', word()])}{pick(['', ':'])} {chars(pick([32, 40, 64]), hexa)}", f"{pick(['uuid', 'id', word()])} {chars(8, hexa)}-{chars(4, hexa)}-{chars(4, hexa)}-{chars(4, hexa)}-{chars(12, hexa)}", f"{pick(['range', 'total:', 'invoice', 'order', 'number', 'part', 'serial'])} {digits(3)}-{digits(3)}-{digits(4)}", word() + digits(rng.randint(1, 3)), " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(2, 16))), " ".join(digits(4) for _ in range(rng.randint(5, 16))), f"{word()}@{word()}", f"@{word()}{n % 100}", f"https://www.{word()}.com/{word()}{n}?id={n % 99}",
            f"{word()} at {word()} {word()}", f"dot {word()}", f"{word()} dot {word()}", f"{word()} at {pick(['the', 'a'])} dot {pick(['of', 'in', word()])} {word()}", f"{word()} at {word()} dot {pick(['of', word()])} {word()}", f"at the {word()} dot {word()}", f"a={n % 9} b={n}", f"x = {n}", f"{word()}={word()}", f"token {n % 500}", f"key {n % 12}", f"secret {word()}", f"password {word()}", f"{n % 100}%", f"<|{word()}|>", f"No. {n}", f"{n}th", f"{word()}-{n % 99}", chars(rng.randint(12, 16), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ])

    text, spans = pick([prose(rng.randint(1, 4)), prose(2), " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(1, 5)))]), []
    for _ in range(rng.randint(1, 3)):
        kind = pick([0, 1, 2, 3, 3, 4, 4, 4, None, None, None, None, None])
        lead, value, tail = ("", other(), "") if kind is None else [address, lambda: ("", ".".join(str(rng.randrange(256)) for _ in range(4)), pick(["", ".", ","])), card, phone, secret][kind]()
        if kind is not None:
            at = len(text) + 1 + len(lead)
            spans.append((at, kind, at + len(value)))
        near = prose(rng.randint(1, 3)) if kind != BASE or rng.random() < 0.7 else " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(1, 9)))
        text += f" {lead}{value}{tail} {near}"
    return text, spans


_MARK = re.compile(r"\[(email|phone|secret):((?:[^\[\]]|\[[a-z]+\])+)\]")


def marked_rows() -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The lines marked by hand, each span written as [kind:value] in its file."""
    out = []
    for line in pkgutil.get_data(__package__, "pii_labels.txt").decode("utf-8").splitlines():
        text, spans, last = "", [], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
            text, last = text + m[2], m.end()
        out.append((text + line[last:], spans))
    return out


def labelled_rows(rows: int = 1_200, seed: int = 17, marked: list | None = None, times: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``rows`` synthetic lines with their spans, the same for the same seed, and the ``marked`` ones (all of them, if none are
    given) ``times`` times."""
    rng = random.Random(seed)
    return [_row(rng) for _ in range(rows)] + (marked_rows() if marked is None else marked) * times


def labelled_table(spark: SparkSession, rows: int = 1_200, seed: int = 17) -> DataFrame:
    """The small labelled table ``text string, spans array<struct<a:int,kind:int,b:int>>``."""
    return spark.createDataFrame(labelled_rows(rows, seed), "text string, spans array<struct<a:int,kind:int,b:int>>")


def examples_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[str], tuple[str, ...], list[int]]]:
    """The candidate runs of a labelled line, with the words before each and the states of its words. Internet addresses and
    cards are what their base patterns and checks say, no more, so the field learns them as outside."""
    spans = [x for x in spans if x[1] not in (1, 2)]
    return [([text[a:b] for a, b in run], words_before(text, run[0][0]), tag_run(text, run, spans)) for run in candidate_runs(text)]


def _trimmed(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    if BASE == kind:  # the value of name=value, without quotes
        m = re.search(r"^[\"'({\[]*[A-Za-z_][A-Za-z_.-]*[\"']?[=:](?=.)", text[a:b])
        a += m.end() if m else 0
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < b and not (text[b - 1].isalnum() or text[b - 1] == ")"):
        b -= 1
    return a, b


def _holds(kind: int, value: str) -> bool:
    """What any span of a kind must be, however it was found."""
    digits = _digits(value)
    if kind == 0:
        return "@" in value or bool(re.search(r"\bat\b.*\bdot\b", value, re.I | re.S))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value)) and _octets(value)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 if kind == 3 else len(value) >= 6


def find_spans(texts: list[str | None], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Spans that the field adds never touch a base span."""
    bases = [base_spans(t) if t else [] for t in texts]
    added: list[list] = [[] for _ in texts]
    merged: dict[int, tuple[list[int], list[int]]] = {}

    def covered(k: int, a: int, b: int) -> bool:
        if k not in merged:  # base spans as disjoint stretches
            starts: list[int] = []
            ends: list[int] = []
            for s, _, e in bases[k]:
                if ends and s <= ends[-1]:
                    ends[-1] = max(ends[-1], e)
                else:
                    starts.append(s)
                    ends.append(e)
            merged[k] = starts, ends
        starts, ends = merged[k]
        i = bisect.bisect_right(ends, a)
        return i < len(starts) and starts[i] < b

    if field is not None and len(field.index):
        runs = [(k, run) for k, t in enumerate(texts) if t for run in candidate_runs(t)]
        runs.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(runs):
            part = runs[at : at + 512]
            while len(part) > 1 and len(part) * len(part[-1][1]) > 16 * SLICE:
                part = part[: len(part) // 2]
            at += len(part)
            paths = field.decode([[texts[k][a:b] for a, b in r] for k, r in part], [words_before(texts[k], r[0][0]) for k, r in part])
            for (k, run), path in zip(part, paths):
                path = path.tolist()
                i = 0
                while i < len(path):
                    if path[i] % 2 == 1:
                        j = i + 1
                        while j < len(path) and path[j] == path[i] + 1:
                            j += 1
                        kind = path[i] // 2
                        a, b = _trimmed(texts[k], kind, run[i][0], run[j - 1][1])
                        if a < b and _holds(kind, texts[k][a:b]) and not covered(k, a, b):
                            added[k].append((a, kind, b))
                        i = j
                    else:
                        i += 1
    return [(b, sorted([*b, *x])) for b, x in zip(bases, added)]


def pii_spans(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, digest of the base spans and all spans of every row. ``labelled`` is small and bounded (a parameter)."""
    examples = [x for r in labelled.collect() for x in examples_of(r.text, [tuple(s) for s in r.spans])]
    field = train(examples) if examples else None
    columns = [f"n_{k}" for k in KINDS[:BASE]]

    @F.pandas_udf(", ".join(f"{c} long" for c in columns) + ", base_sha256 string, spans string, n_spans long, n_added long, n_secret long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            texts = list(texts)
            for at in range(0, len(texts), 1000):
                for base, every in find_spans(texts[at : at + 1000], field):
                    kinds = [sum(k == i for _, k, _ in base) for i in range(BASE)]
                    rows.append((*kinds, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every), len(every), len(every) - len(base), sum(k == BASE for _, k, _ in every)))
            yield pd.DataFrame(rows, columns=[*columns, "base_sha256", "spans", "n_spans", "n_added", "n_secret"])

    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read(spark, sf_dir, "documents"), labelled_table(spark))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
