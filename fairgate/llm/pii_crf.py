"""Personal data by patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns with their checks.
The semi-Markov model then reads what lies around digits and at-signs: its
candidate segments are whole spans of up to ``MAX_UNITS`` units (runs of
letters, digits, or single signs), scored by features of the span as a whole
(digit count, grouping, separators, Luhn, words before it) and the transition
between neighbouring entities.  Dynamic programming over segment ends, with
segments of bounded length, chooses boundaries and kinds jointly.  Text without
candidates scores zero, so decoding the stretches around candidates equals
decoding the whole text, and every whole text is read.

The weights are trained here, by gradient ascent on the exact segment
likelihood (forward-backward over the same lattice): the labelled data are the
stretches of a bounded sample of texts, their gold segments the base spans,
varied by rules that keep the kind (other separators, a dropped plus sign,
words for signs), and texts whose digits are no personal data.

Spans that the model finds beyond the base ones, overlapping none of them, are
added under kinds of their own (``email_like``, ``card_like``, ``phone_like``),
so the base kinds always hold exactly the base spans.

Defined cases: null texts are empty and have no span; offsets are code points,
end exclusive; rows that repeat a doc_id are read one by one; an empty table
gives no rows (and an untrained model adds no span); long runs of digits or
signs are matched in linear time; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textutil import small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
LIKE = ("email_like", "card_like", "phone_like")      # what the model may add
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# The contract's patterns (fixed values); the look-behind only skips starts
# inside a run of digits whose first digit has failed already.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each base kind, leftmost and non-overlapping."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        # what may stand before this sign: back to the last match or sign
        lead = text[done:at]
        start = done + len(lead.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out["phone"].append(m.span())
    return out


# ---- the semi-Markov model ------------------------------------------------

MAX_UNITS = 32             # units of a segment of any kind
MAX_DIGITS = 19            # digits of a segment, the most that any kind has
REACH = 48                 # code points of context around a candidate, then up to white space
_SPACE = re.compile(r"\s")
_UNIT = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_CORE = re.compile(r"[0-9]{2,}|@")
_AT = re.compile(r"[(\[{]at[)\]}]", re.IGNORECASE)
_CUES = {                  # words that announce a kind (fixed values)
    "email": ("email", "mail", "mailto", "contact", "correo", "courriel"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "téléphone", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
}
_CUE_WORDS = {kind: re.compile(r"\b(?:" + "|".join(words) + r")\b") for kind, words in _CUES.items()}
LABELS = ("O", "email", "ip", "card", "phone")
_SPANNED = r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]|@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]"       # a text with a base span has one of these
_MAYBE = r"[0-9]{2}|[0-9]\.[0-9]|[0-9][ -][0-9]|\+[0-9]|@|[(\[{][aA][tT]"                         # and one with any span one of these


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and at-signs, with some context, up to
    the next white space on both sides."""
    cores = sorted(m.span() for pattern in (_CORE, _AT) for m in pattern.finditer(text))
    merged: list[tuple[int, int]] = []
    for a, b in cores:
        last = merged[-1][1] if merged else -1
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        if b > last:
            space = _SPACE.search(text, b)
            b = space.start() if space else len(text)
        # whatever lies before the last stretch's end belongs to it already
        while a > max(last, 0) and not text[a - 1].isspace():
            a -= 1
        if a <= last:
            merged[-1] = (merged[-1][0], max(b, last))
        else:
            merged.append((a, b))
    return merged


def _shape(s: str) -> str:
    return re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)), re.sub(r"[^\W\d_]+", "a", s))


def cues(text: str, a: int) -> list[str]:
    """Kinds that a word shortly before ``a`` announces."""
    before = text[max(0, a - REACH):a].lower()
    return [f"cue{kind}" for kind, words in _CUE_WORDS.items() if words.search(before)]


def span_features(text: str, a: int, b: int, announced: list[str]) -> list[str]:
    """Features of the segment text[a:b] as a whole."""
    s = text[a:b]
    d = _digits(s)
    n, letters = len(d), sum(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    f = [f"n{min(n, 20)}", f"groups{min(len(groups), 6)}", f"letters{min(letters, 3)}", f"first{_kind(s[0])}", f"last{_kind(s[-1])}",
         f"left{_kind(text[a - 1]) if a else '^'}", f"right{_kind(text[b]) if b < len(text) else '$'}"]
    if letters == 0:
        f.append("shape" + _shape(s)[:24])
    if "@" in s:
        f.append("at1" if s.count("@") == 1 else "at2")
    if re.fullmatch(r"[0-9A-Za-z._%+-]+\s?(?:@|\(at\)|\[at\]|\{at\})\s?[0-9A-Za-z-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[0-9A-Za-z-]+)+", s, re.IGNORECASE):
        f.append("address")
    if letters == 0 and 13 <= n <= 19:
        f.append("luhn" if luhn(d) else "noluhn")
    if len(groups) == 4 and s.count(".") == 3 and letters == 0:
        f.append("quad" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "noquad")
    if letters == 0:
        f.append("seps" + "".join(sorted(set(s) - set("0123456789"))))
        f.append("even" if len({len(g) for g in groups[:-1]}) <= 1 else "uneven")
    return f + announced


def _kind(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c


@dataclass
class SemiCrf:
    weights: dict[tuple[str, str], float]        # (label, feature)
    between: np.ndarray                          # label x label: the entity before (or O) and this one


def unit_ends(text: str, a: int, b: int) -> list[int]:
    return [a] + [m.end() for m in _UNIT.finditer(text, a, b)]


def segments_of(text: str, ends: list[int]) -> Iterator[tuple[int, int, list[str]]]:
    """Candidate segments (first unit, end unit, features) in the order of
    their starts: at most MAX_UNITS units, with two digits or an at-sign, from
    a letter, digit, plus or parenthesis to a letter or digit."""
    a, b, n = ends[0], ends[-1], len(ends) - 1
    marks = [m.start() for m in _AT.finditer(text, a, b)]
    for i in range(n):
        s = ends[i]
        c = text[s]
        if not (c.isalnum() or c in "+(") or (i == 0 and s and c.isalnum() and text[s - 1].isalnum()):
            continue
        digits = signs = letters = False
        count, announced = 0, cues(text, s)
        for j in range(i, min(n, i + MAX_UNITS)):
            first, size = text[ends[j]], ends[j + 1] - ends[j]
            count += size if "0" <= first <= "9" else 0
            if first == "\n" or count > MAX_DIGITS:
                break
            digits |= "0" <= first <= "9" and size > 1
            letters |= first.isalpha()
            signs |= first == "@" or (bool(marks) and any(s <= m < ends[j + 1] for m in marks))
            if (digits or signs) and first.isalnum() and (signs or not letters):
                yield i, j + 1, span_features(text, s, ends[j + 1], announced)


def decode(model: SemiCrf, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """The best segmentation of the stretch: (kind, start, end) of its
    entities.  Segments are scored as they come, so memory grows with the
    stretch alone."""
    ends = unit_ends(text, a, b)
    n, get = len(ends) - 1, model.weights.get
    best = np.full((n + 1, len(LABELS)), -np.inf)       # by what ends here: plain text (O) or an entity
    came: dict[tuple[int, int], tuple[int, int]] = {}   # entity ending here: its start and what ended there
    plain = np.zeros(n + 1, dtype=np.int8)              # plain unit ending here: what ended before it
    best[0, 0] = 0.0
    at = 0
    for i, j, feats in itertools.chain(segments_of(text, ends), [(n, n, [])]):
        while at < i:                                    # plain text up to the segment's start
            k = int(best[at].argmax())
            if best[at, k] > best[at + 1, 0]:
                best[at + 1, 0], plain[at + 1] = best[at, k], k
            at += 1
        if i == j:
            break
        for y in range(1, len(LABELS)):
            score = get((LABELS[y], "*"), 0.0) + sum(get((LABELS[y], f), 0.0) for f in feats)
            step = best[i] + model.between[:, y]
            k = int(step.argmax())
            if step[k] + score > best[j, y]:
                best[j, y], came[j, y] = step[k] + score, (i, k)
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        if y:
            i, k = came[j, y]
            out.append((LABELS[y], ends[i], ends[j]))
            j, y = i, k
        else:
            j, y = j - 1, int(plain[j])
    return out[::-1]


def fit_crf(data: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 40, rate: float = 0.5, l2: float = 0.02) -> SemiCrf:
    """Maximum likelihood of whole segmentations; ``data`` are stretches with
    their gold entities."""
    prepared, names = [], {}
    for text, gold in data:
        ends = unit_ends(text, 0, len(text))
        segments = list(segments_of(text, ends))
        at = {(ends[i], ends[j]): k for k, (i, j, _) in enumerate(segments)}
        gold = [(LABELS.index(kind), at[(a, b)]) for kind, a, b in gold if (a, b) in at]
        feats = [[names.setdefault(f, len(names)) for f in fs] for _, _, fs in segments]
        prepared.append((len(ends) - 1, [(i, j) for i, j, _ in segments], feats, gold))
    w, between = np.zeros((len(LABELS) - 1, len(names) + 1)), np.zeros((len(LABELS), len(LABELS)))
    w2, b2 = np.full_like(w, 1e-6), np.full_like(between, 1e-6)
    for _ in range(steps):
        gw, gb = -l2 * w, -l2 * between
        for n, spans, feats, gold in prepared:
            if not spans:
                continue
            flat = np.concatenate([np.array(f) for f in feats])
            cut = np.cumsum([0] + [len(f) for f in feats])[:-1]
            score = np.add.reduceat(w[:, flat], cut, axis=1).T + w[:, -1]
            fwd, bwd = np.full((n + 1, len(LABELS)), -np.inf), np.full((n + 1, len(LABELS)), -np.inf)
            fwd[0, 0] = 0.0
            by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for k, (i, j) in enumerate(spans):
                by_end[j].append(k)
                by_start[i].append(k)
            for j in range(1, n + 1):
                fwd[j, 0] = np.logaddexp.reduce(fwd[j - 1])
                for k in by_end[j]:
                    v = np.logaddexp.reduce(fwd[spans[k][0]][:, None] + between[:, 1:], axis=0) + score[k]
                    fwd[j, 1:] = np.logaddexp(fwd[j, 1:], v)
            bwd[n] = 0.0
            for i in range(n - 1, -1, -1):
                bwd[i] = bwd[i + 1, 0]
                for k in by_start[i]:
                    v = between[:, 1:] + score[k] + bwd[spans[k][1], 1:]
                    bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(v, axis=1))
            z = np.logaddexp.reduce(fwd[n])
            for k, (i, j) in enumerate(spans):
                p = np.exp(np.minimum(fwd[i][:, None] + between[:, 1:] + score[k] + bwd[j, 1:] - z, 0))
                gb[:, 1:] -= p
                p = p.sum(axis=0)
                np.subtract.at(gw, (slice(None), np.array(feats[k])), p[:, None])
                gw[:, -1] -= p
            last = (0, 0)                                # label and end of the entity before
            for y, k in gold:
                i, j = spans[k]
                gb[last[0] if last[1] == i else 0, y] += 1
                np.add.at(gw, (y - 1, np.array(feats[k])), 1)
                gw[y - 1, -1] += 1
                last = (y, j)
        gw, gb = gw / len(prepared), gb / len(prepared)
        w2 += gw ** 2
        b2 += gb ** 2
        w += rate * gw / np.sqrt(w2)
        between += rate * gb / np.sqrt(b2)
    weights = {(k, f): float(w[y, c]) for f, c in names.items() for y, k in enumerate(LABELS[1:])}
    weights |= {(k, "*"): float(w[y, -1]) for y, k in enumerate(LABELS[1:])}
    return SemiCrf(weights, between)


def _variants(text: str, gold: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The stretch with its entities written another way of the same kind."""
    out, new, at = [], [], 0
    for kind, a, b in gold:
        s = text[a:b]
        out.append(text[at:a])
        way = rng.integers(4)
        cue = kind in _CUES and rng.random() < 0.5
        if kind == "card" and way:
            d = _digits(s)
            s = ("", "-", " ", "")[way].join(d[i:i + 4] for i in range(0, len(d), 4)) if way < 3 else s
        elif kind == "phone" and way:
            d = _digits(s)
            s = (s, f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}")[way] if len(d) >= 10 else s
        elif kind == "email" and way > 1:
            s = s.replace("@", (" at ", "(at)", " [at] ")[way - 1] if way < 3 else " [at] ")
            cue = True
        if cue:
            words = _CUES[kind]
            out.append(words[rng.integers(len(words))] + (": " if rng.random() < 0.5 else " "))
        start = sum(map(len, out))
        out.append(s)
        new.append((kind, start, start + len(s)))
        at = b
    out.append(text[at:])
    return "".join(out), new


def _noise(text: str, gold: list[tuple[str, int, int]], rng: np.random.Generator) -> str:
    """The stretch with numbers that are nobody's: years, amounts, versions, ids."""
    a, b = gold[0][1], gold[-1][2]
    pick = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    kinds = (f"{rng.integers(1900, 2030)}", f"{pick(2)}.{pick(2)}", f"{pick(1)}.{pick(1)}.{pick(2)}", f"${pick(3)},{pick(3)}", pick(int(rng.integers(5, 13))),
             f"{rng.integers(1900, 2030)}-{pick(2)}-{pick(2)}", f"{pick(4)} {pick(2)}", f"#{pick(6)}", f"{pick(2)}:{pick(2)}:{pick(2)}")
    card = pick(16)
    kinds += ((card if not luhn(card) else pick(6)),)
    return text[:a] + kinds[rng.integers(len(kinds))] + text[b:]


def train(docs: DataFrame, max_texts: int = 300, steps: int = 25, seed: int = 3,
          id_col: str = "doc_id", text_col: str = "text") -> SemiCrf | None:
    """Fit on at most ``max_texts`` texts with a digit pattern or an at-sign
    (those with the smallest hash of their text) and varied copies of them."""
    src = texts_of(docs, id_col, text_col).select("text")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            text = batch.column("text")
            for text in text.filter(pc.match_substring_regex(text, _SPANNED)).to_pylist():
                found = sorted((a, b, k) for k, spans in base_spans(text).items() for a, b in spans)
                for a, b, _ in found[:2]:
                    lo, hi = max(0, a - 2 * REACH), min(len(text), b + 2 * REACH)
                    out.append(text[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["piece"])

    # pieces of bounded length, a bounded number of them
    pieces = src.mapInArrow(cut, "piece string").orderBy(F.xxhash64("piece"), "piece").limit(max_texts).collect()
    rng = np.random.default_rng(seed)
    data = []
    for r in pieces:
        text = r["piece"]
        found = sorted((a, b, k) for k, spans in base_spans(text).items() for a, b in spans)
        gold, end = [], 0
        for a, b, k in found:
            if a >= end:
                gold.append((k, a, b))
                end = b
        if not gold:
            continue
        data.append((text, gold))
        data.append(_variants(text, gold, rng))
        data.append((_noise(text, gold, rng), []))
    return fit_crf(data, steps) if data else None


def all_spans(text: str, model: SemiCrf | None) -> list[tuple[str, int, int]]:
    """Base spans, then what the model adds, by kind and start."""
    if not any(c in text for c in "0123456789@") and "(at" not in text.lower() and "[at" not in text.lower() and "{at" not in text.lower():
        return []
    base = base_spans(text)
    out = [(k, a, b) for k in KINDS for a, b in base[k]]
    if model is None:
        return out
    taken = sorted((a, b) for _, a, b in out)
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in LIKE}
    for lo, hi in stretches(text):
        for kind, a, b in decode(model, text, lo, hi):
            if f"{kind}_like" in more and not any(a < y and x < b for x, y in taken):
                more[f"{kind}_like"].append((a, b))
    return out + [(k, a, b) for k in LIKE for a, b in sorted(more[k])]


def find_pii(docs: DataFrame, model: SemiCrf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end,
    comma-joined) and n_added of every row."""
    src = texts_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            text = batch.column("text")
            maybe = pc.match_substring_regex(text, _MAYBE).to_numpy(zero_copy_only=False)
            found = [all_spans(text[i].as_py(), model) if m else [] for i, m in enumerate(maybe)]
            base = [[s for s in spans if s[0] in KINDS] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(write(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([write(s) for s in found], pa.string()), pa.array([len(s) - len(b) for s, b in zip(found, base)], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(apply, f"doc_id {id_type}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")


def semi_markov_pii(docs: DataFrame, **options) -> DataFrame:
    return find_pii(docs, train(docs, **options))
