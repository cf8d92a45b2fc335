"""Personal data in whole texts: fixed rules, and a character tagger that adds what they miss.

The rules (``base_spans``) find well-formed mail addresses, network addresses, cards and phones in time linear in the text.  A
bidirectional LSTM with CRF transitions, trained in numpy from labelled spans, adds others: two cards that stand side by
side, phones without a plus or run together with other numbers, separators of other kinds, addresses written with (at).
Its labels are the rules' spans in a bounded sample of documents (``SAMPLE_DOCS``, ``SAMPLE_WINDOWS``) and planted variants of
each kind between words of the same sample, with look-alikes that are none.

A text is cut into cores of ``CORE`` characters, each of which is decoded with ``CONTEXT`` more on both sides, so windows
overlap; of a character's readings that of its own core counts, and spans are read off the tags of the whole text, so they may
cross any number of windows.  A span is added if it passes the check of its kind and meets no span of the rules.
Each check asks for a digit or an at sign, so windows without one can add nothing; they are decoded only when a span
from a neighbour runs into them.  Tests hold that against decoding every window.

A map over the documents without a shuffle; the model (some 20,000 numbers) travels in its closure.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import bilstm
from cuelake.llm.common import arrow_schema, batch_of, slices

KINDS = ("email", "ip", "card", "phone")
CORE, CONTEXT, AT_ONCE, CHARS_AT_ONCE = 96, 24, 4096, 1 << 22
WINDOW = CORE + 2 * CONTEXT
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 2000
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 400, 32, 0.03, 13

# --- rules -------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_address(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the rules find, in that order; per kind leftmost and without overlaps."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [(*_at(m, 1),) for m in _IP.finditer(text) if _is_address(m[0].split("."))]
        out += [(*_at(m, 2),) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and _is_card(m[0])]
        if "+" in text:
            out += [(*_at(m, 3),) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def _at(m: re.Match, kind: int) -> tuple[int, int, int]:
    return m.start(), kind, m.end()


# --- characters, tags and labelled windows -----------------------------------------------------------------------

PAD, DIGIT, LETTER, SPACE, BREAK, OTHER, FIRST = 0, 1, 2, 3, 4, 5, 6
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHARS = FIRST + 26 + len(PUNCTUATION)
TAGS = 1 + 2 * len(KINDS)  # none, then opens and goes on, a kind


def _char_table() -> np.ndarray:
    """Classes of the code points to U+02FF: digits are one, letters go without case, those beyond ASCII are one."""
    out = np.full(0x300, OTHER, np.uint8)
    out[[9, 32, 0xA0]], out[[10, 11, 12, 13]], out[0xAA:] = SPACE, BREAK, LETTER
    out[48:58] = DIGIT
    for k in range(26):
        out[[65 + k, 97 + k]] = FIRST + k
    for k, c in enumerate(PUNCTUATION):
        out[ord(c)] = FIRST + 26 + k
    return out


_TABLE = _char_table()
_AT = FIRST + 26 + PUNCTUATION.index("@")


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x300, _TABLE[np.minimum(codes, 0x2FF)], np.where(codes < 0x2000, LETTER, OTHER)).astype(np.uint8)


def forbidden() -> np.ndarray:
    """Added to transitions: a span goes on only after it has opened."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = bilstm.NEVER
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of ``n`` characters; of spans that overlap the first counts."""
    out = np.zeros(n, np.uint8)
    for start, kind, end in spans:
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def _sample(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[str, list]]:
    """At most ``SAMPLE_WINDOWS`` (window, spans of the rules in it) from documents of the smallest hashes of their ids."""
    key = F.xxhash64(F.lit(SEED), F.col(id_col))
    some = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    edge = some.select(key.alias("k")).orderBy("k").limit(SAMPLE_DOCS).agg(F.max("k")).first()[0]
    if edge is None:
        return []
    schema = arrow_schema("k long,text string")

    def run(batches):
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = base_spans(text)
                middles = [(s + e) // 2 for s, _, e in found[:: max(1, len(found) // 2)][:2]] + [(k & 0xFFFF) % max(1, len(text))]
                parts = [text[max(0, m - WINDOW // 2 + (k >> 20) % 60 - 30) :][:WINDOW] for m in middles]
                yield batch_of(schema, k=[k] * len(parts), text=parts)

    windows = some.where(key <= edge).select(key.alias("k"), text_col).mapInArrow(run, "k bigint, text string")
    rows = windows.orderBy("k", "text").limit(SAMPLE_WINDOWS).collect()
    return [(r.text, base_spans(r.text)) for r in rows if r.text]


def _number(rng, n: int) -> str:
    return "".join(str(rng.integers(10)) for _ in range(n))


def _card_number(rng) -> str:
    body = _number(rng, int(rng.choice([13, 14, 15, 15, 15, 18])))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def planted(kind: int, rng) -> str:
    """A written form of a kind, well-formed or not by the rules."""
    if kind == 0:
        word = lambda: "".join("abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] for _ in range(rng.integers(2, 10)))
        local = str(rng.choice([".", "_", "", "-"])).join(word() for _ in range(rng.integers(1, 3))) + (_number(rng, 2) if rng.random() < 0.4 else "")
        dot = str(rng.choice([".", ".", ".", " (dot) ", "[dot]"]))
        at = "@" if dot == "." and rng.random() < 0.7 else str(rng.choice([" (at) ", "[at]", "(at)", " [at] "]))
        return local + at + dot.join(word() for _ in range(rng.integers(2, 4)))
    if kind == 1:
        return str(rng.choice([".", ".", ".", "[.]"])).join(str(rng.integers(256)) for _ in range(4))
    if kind == 2:
        digits, gap = _card_number(rng), str(rng.choice(["", "", "", " ", "-", ".", "/"]))
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    n = [_number(rng, k) for k in (3, 3, 4)]
    forms = ["+1 ({}) {}-{}", "+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+44 {} {} {}", "00 49 {} {} {}", "+33{}{}{}", "+1-{}-{}-{}", "({}) {} {}"]
    return str(rng.choice(forms)).format(*n)


def decoy(rng) -> str:
    """What looks like one and is none."""
    a, b, c = (int(rng.integers(1, k)) for k in (13, 29, 100))
    forms = [f"20{c:02d}-{a:02d}-{b:02d}", f"{a}:{b:02d}", f"{b}.{c}", f"v{a}.{b}.{c}", f"{a},{c:03d}.{b:02d}", f"@{'abcdefgh'[:a]}", f"No. {_number(rng, 5)}", _number(rng, 8), f"{a}-{b}", f"19{c:02d}", f'token = "{rng.bytes(16).hex()}"', f"#{_number(rng, 6)}", f"{a}/{b}/20{c:02d}", f"({c})", f"+{a}"]
    return forms[int(rng.integers(len(forms)))]


def labelled(sample: list[tuple[str, list]], seed: int = SEED, extra: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (classes, tags): those of the sample, and ``extra`` in which variants and look-alikes stand between words of it."""
    rng = np.random.default_rng(seed)
    words = [w for text, _ in sample for w in text.split() if not re.search(r"[0-9@]", w)][:20_000] or ["the", "of", "and", "to", "word"]
    windows = list(sample)
    for _ in range(extra):
        text, spans = "", []
        while len(text) < WINDOW:
            what = rng.random()
            if what < 0.2:
                for _ in range(1 + (rng.random() < 0.35)):
                    kind = int(rng.integers(len(KINDS)))
                    form = planted(kind, rng)
                    spans.append((len(text), kind, len(text) + len(form)))
                    text += form + str(rng.choice([" ", " ", " ", ", ", ". ", "; ", "\n"]))
            elif what < 0.32:
                text += decoy(rng) + " "
            else:
                text += str(words[int(rng.integers(len(words)))]) + " "
        shift = int(rng.integers(0, 40))
        windows.append((text[shift : shift + WINDOW], [(max(0, s - shift), k, min(WINDOW, e - shift)) for s, k, e in spans if s < shift + WINDOW and e > shift]))
    ids, tags = np.zeros((len(windows), WINDOW), np.uint8), np.zeros((len(windows), WINDOW), np.uint8)
    for row, (text, spans) in enumerate(windows):
        ids[row, : len(text)] = classes(text)
        tags[row, : len(text)] = tags_of(len(text), spans)
    return ids, tags


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> bilstm.Tagger:
    """A tagger for texts like those of ``docs``, fitted on the driver on a sample of fixed size."""
    ids, tags = labelled(_sample(docs, id_col, text_col))
    return bilstm.Tagger(bilstm.fit(ids, tags, CHARS, HIDDEN, forbidden(), steps, BATCH, RATE, SEED), forbidden())


# --- decoding ----------------------------------------------------------------------------------------------------

_WRITTEN_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[(\[{] ?at ?[)\]}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_IP_FORM = re.compile(r"[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}")
_CARD_FORM = re.compile(r"[0-9](?:[ ./-]?[0-9])+")
_PHONE_FORM = re.compile(r"\+?[ (]*[0-9](?:[ ().0-9/-]*[0-9])+")


def confirmed(text: str, start: int, kind: int, end: int) -> tuple[int, int, int] | None:
    """The span with its ends moved to whole numbers or words, if it passes the check of its kind."""
    inner = (lambda c: c in _LOCAL and c not in ".-%+_") if kind == 0 else (lambda c: "0" <= c <= "9")
    while start < end and text[start] in " \t\n\r,;:":
        start += 1
    while start < end and text[end - 1] in " \t\n\r,;:.!?-(":
        end -= 1
    if start >= end:
        return None
    while start > 0 and inner(text[start]) and inner(text[start - 1]):
        start -= 1
    while end < len(text) and inner(text[end - 1]) and inner(text[end]):
        end += 1
    own = text[start:end]
    if kind == 0:
        good = bool(_EMAIL_FORM.fullmatch(own))
    elif kind == 1:
        good = bool(_IP_FORM.fullmatch(own)) and _is_address(re.findall("[0-9]+", own))
    elif kind == 2:
        good = bool(_CARD_FORM.fullmatch(own)) and _is_card(own)
    else:
        digits = digits_of(own)
        good = bool(_PHONE_FORM.fullmatch(own)) and 10 <= len(digits) <= 15 and (own[0] == "+" or len(re.findall("[0-9]+", own)) >= 3)
    return (start, kind, end) if good else None


def _windows(ids: list[np.ndarray], at: list[tuple[int, int]]) -> np.ndarray:
    out = np.full((len(at), WINDOW), PAD, np.uint8)
    for row, (text, core) in enumerate(at):
        low = core * CORE - CONTEXT
        part = ids[text][max(0, low) : low + WINDOW]
        out[row, max(0, -low) : max(0, -low) + len(part)] = part
    return out


def tag_texts(tagger: bilstm.Tagger, texts: list[str], every: bool = False) -> list[np.ndarray]:
    """The tags of each text.  ``every``: decode all windows, not only those that can add a span."""
    ids = [classes(t) for t in texts]
    tags = [np.zeros(len(x), np.uint8) for x in ids]
    done = [np.zeros(-(-len(x) // CORE), bool) for x in ids]
    todo: list[tuple[int, int]] = []
    for k, (text, x) in enumerate(zip(texts, ids, strict=True)):
        spots = np.flatnonzero((x == DIGIT) | (x == _AT))
        written = [p for m in _WRITTEN_AT.finditer(text) for p in (m.start(), m.end() - 1)] if "at" in text or "AT" in text or "At" in text or "aT" in text else []
        cores = np.arange(len(done[k])) if every else np.unique(np.concatenate([spots, np.array(written, np.int64)]) // CORE)
        done[k][cores] = True
        todo += [(k, int(c)) for c in cores]
    while todo:
        fresh = []
        for low in range(0, len(todo), AT_ONCE):
            some = todo[low : low + AT_ONCE]
            for (k, core), row in zip(some, tagger.decode(_windows(ids, some)), strict=True):
                own = row[CONTEXT : CONTEXT + CORE][: len(ids[k]) - core * CORE]
                if not own.any():
                    continue
                tags[k][core * CORE : core * CORE + len(own)] = own
                first_goes_on, last_open = own[0] and own[0] % 2 == 0, own[-1]
                for beside in ([core - 1] if first_goes_on else []) + ([core + 1] if last_open else []):
                    if 0 <= beside < len(done[k]) and not done[k][beside]:
                        done[k][beside] = True
                        fresh.append((k, beside))
        todo = fresh
    return tags


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of one kind; an opening tag starts a new one."""
    kind = (tags.astype(np.int16) + 1) // 2
    before = np.concatenate([[0], kind[:-1]])
    opens = np.flatnonzero((kind > 0) & ((kind != before) | (tags % 2 == 1)))
    if not len(opens):
        return []
    ends = np.flatnonzero((kind > 0) & (np.concatenate([kind[1:], [0]]) != kind)) + 1
    stops = np.minimum(np.append(opens[1:], len(tags)), ends[np.searchsorted(ends, opens, side="right")])
    return list(zip(opens.tolist(), (kind[opens] - 1).tolist(), stops.tolist(), strict=True))


def all_spans(tagger: bilstm.Tagger, texts: list[str], every: bool = False) -> list[tuple[list, list]]:
    """(spans of the rules, spans added) for each text."""
    out = []
    for text, tags in zip(texts, tag_texts(tagger, texts, every), strict=True):
        base = base_spans(text)
        added: list[tuple[int, int, int]] = []
        if tags.any():
            starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
            for found in tagged_spans(tags):
                span = confirmed(text, *found)
                if span is None or (added and added[-1][2] > span[0]):
                    continue
                before = bisect_left(starts, span[2])  # spans of the rules that begin before it ends
                if not before or reach[before - 1] <= span[0]:
                    added.append(span)
        out.append((base, added))
    return out


# --- operators ---------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find(docs: DataFrame, tagger: bilstm.Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end in code points, whether the rules found it), by start, then kind; replaced if present.

    Null and empty texts have none; repeated rows have the same; other columns are kept whatever their names.  Without a tagger
    one is trained on a sample of ``docs`` (of an empty table: on planted windows only).
    """
    tagger = tagger or train(docs, id_col, text_col)
    rows = docs.drop("spans")
    at = rows.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            texts = b.column(at)
            for p, q in slices((x.as_py() for x in texts), CHARS_AT_ONCE):
                part = b.slice(p, q - p)
                found = [sorted([(*x, True) for x in base] + [(*x, False) for x in added]) for base, added in all_spans(tagger, [t or "" for t in texts.slice(p, q - p).to_pylist()])]
                cells = [[{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, kind)], names=[*part.schema.names, "spans"])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast(SPANS).alias("spans")).schema)


def redact(docs: DataFrame, tagger: bilstm.Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by ``[KIND]``; spans that overlap become one mark, that of the first."""
    found = find(docs, tagger, id_col, text_col)
    at = found.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                text, out, upto = text.as_py(), [], 0
                for x in spans.as_py() if text is not None else []:
                    if x["start"] >= upto:
                        out += [text[upto : x["start"]], f"[{x['kind'].upper()}]"]
                    upto = max(upto, x["end"])
                texts.append(None if text is None else "".join(out) + text[upto:])
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return found.mapInArrow(run, found.drop("spans").schema)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone: what the rules found; base_sha256; spans: all, as text; n_added) of a table of ``find``."""
    base = F.filter("spans", lambda x: x["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("bigint")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("bigint")
    return found.select(id_col, *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), added.alias("n_added"))
