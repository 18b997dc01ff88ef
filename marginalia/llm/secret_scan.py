"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on labelled random strings, one on labelled ordinary identifiers; a run of key
characters whose mean log-likelihood ratio per character passes a threshold is a secret (``markov``). In any
other run the highest-scoring segments are secrets (``part``), so that a key is found behind or before ordinary
characters. The patterns' spans (``assign, access, hex``) always stay; the models add spans where no pattern's
span is, also in what those spans leave of a run.
Whole texts are scanned, one Arrow function per partition, no shuffle.

Defined cases: a null text counts as empty and has no spans; a null id stays null; repeated rows are
scanned each; a very long text is scanned in one pass, in time and memory in proportion to its length (runs of
key characters are scored in blocks); an empty table gives an empty result; other columns pass through
``redact`` untouched.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bound_batches, lean, slices, texts_of

KINDS = ("assign", "access", "hex", "markov", "part")
# The three patterns of the contract.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# A run of 24 or more is the whole run of HEX there.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Least characters of a candidate, or of what the patterns' spans leave of it.
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Mean log-likelihood ratio in nats a character above which a candidate is a secret.
THRESHOLD = 0.6
#: A segment of a run: each character's ratio, at most ``CLIP`` either way, counts less ``OFFSET``; one that comes to ``SEGMENT`` is
#: a secret, and ends where the sum is ``DROP`` below its best. Chosen on labelled strings the models were not trained on.
OFFSET, CLIP, SEGMENT, DROP = 0.3, 3.0, 18.0, 9.0
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Words the ordinary identifiers of the training sample are made of.
WORDS = (
    "the and for with from this that have will user name file path list item count index value error result request response server client "
    "config option default table column row data base type class object method function return string number token cache buffer stream reader "
    "writer handler manager service factory builder parser lexer node tree graph edge vertex weight score model train test batch layer input "
    "output image video audio text word line page document title author date time year month day hour minute second zone local remote global "
    "public private static final abstract interface package module import export select insert update delete where order group limit offset "
    "nicht einer haben werden schaft keit heit lich ungen zwischen verein gesell arbeit entwicklung geschichte recht "
    "para como pero todos ciones mente nuestra palabra historia trabajo desarrollo informacion dades "
    "dans avec pour elle ment tion aux leur histoire travail developpement entreprise question toujours "
    "over under inter national station nation ation able ing ness ship ment ther thing ough ever where there which would about other these"
).split()


def labelled_samples(seed: int = 7, n: int = 4000) -> list[tuple[str, int]]:
    """Labelled strings the two models are trained on: 1 for random strings, 0 for ordinary identifiers."""
    rng, out = random.Random(seed), []
    kinds = [string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits]
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 64))), 1))
        words = rng.choices(WORDS, k=rng.randint(2, 7))
        style = rng.randrange(7)
        name = ["_".join(words), "-".join(words), "".join(words), "".join(w.title() for w in words), "/".join(words), "_".join(words).upper(), "".join(w.title() if i else w for i, w in enumerate(words))][style]
        if rng.random() < 0.3:
            name += rng.choice(["_", "-", ""]) + str(rng.choice([rng.randrange(100), rng.randrange(1900, 2100), rng.randrange(10**6)]))
        out.append((name, 0))
    for _ in range(n // 8):
        out.append((rng.choice(["-", "=", "_", "/", "+", "-=", "a", "x", "0"]) * rng.randint(10, 40), 0))
        out.append(("".join(rng.choices("0123456789", k=rng.randint(6, 30))), 0))
        out.append((f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}/{rng.randrange(10**4)}", 0))
    out += [(c * rng.randint(10, 60), 0) for c in ALPHABET for _ in range(30 * n // 4000)]
    return out


@cache
def models(order: int = 2) -> np.ndarray:
    """Log-likelihood ratios of a character after ``order`` others, random over ordinary, add-half smoothed."""
    size = len(ALPHABET) + 1
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = np.full((2, size**order, size), 0.5 / size)
    for text, label in labelled_samples():
        at = 0
        for c in text:
            counts[label, at, code[c]] += 1
            at = (at * size + code[c]) % size**order
    # back off to the last character's counts where a context is rare
    short = counts.reshape(2, size ** (order - 1), size ** (order - 1), size).sum(1) if order > 1 else counts
    short = short / short.sum(-1, keepdims=True)
    counts += 8 * np.tile(short, (1, size ** (order - 1), 1)) if order > 1 else 0
    p = np.log(counts / counts.sum(-1, keepdims=True))
    return p[1] - p[0]


_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)


def ratios(text: str, order: int = 2, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Log-likelihood ratios of a run's characters, random strings over ordinary identifiers, a block at a time."""
    ratio, size = models(order), len(ALPHABET) + 1
    before = np.zeros(order, np.int64)
    for at in range(0, len(text), block):
        x = np.concatenate([before, _CODE[np.frombuffer(text[at : at + block].encode(), np.uint8)]])
        context = sum(x[i : len(x) - order + i] * size ** (order - 1 - i) for i in range(order))
        yield ratio[context, x[order:]]
        before = x[len(x) - order :]


def llr(text: str, order: int = 2, block: int = 1 << 16) -> float:
    """Mean log-likelihood ratio per character."""
    return sum(float(r.sum()) for r in ratios(text, order, block)) / len(text)


def segments(text: str, least: int = LEAST) -> list[tuple[int, int]]:
    """The highest-scoring segments of a run, of at least ``least`` characters, in one pass."""
    out: list[tuple[int, int]] = []
    start, end, at, total, best = 0, 0, 0, 0.0, 0.0

    def close() -> None:
        if best >= SEGMENT and end - start >= least:
            out.append((start, end))

    for block in ratios(text):
        for value in np.clip(block, -CLIP, CLIP).tolist():
            at, total = at + 1, total + value - OFFSET
            if total > best:
                best, end = total, at
            elif total <= 0 or total < best - DROP:
                close()
                start, total, best = at, 0.0, 0.0
    close()
    return out


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all secrets of a text, by start, then kind; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    found.sort()
    added, i = [], 0
    base: list[tuple[int, int]] = []  # spans of patterns, those that touch made one
    for a, _, b in found:
        if base and a <= base[-1][1]:
            base[-1] = (base[-1][0], max(b, base[-1][1]))
        else:
            base.append((a, b))
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while i < len(base) and base[i][1] <= a:
            i += 1
        j = i
        while a < end:
            s, e = base[j] if j < len(base) and base[j][0] < end else (end, end)
            if s - a >= LEAST:
                run = text[a:s]
                if llr(run) > threshold:
                    added.append((a, 3, s))
                else:
                    added += [(a + x, 4, a + y) for x, y in segments(run)]
            a, j = e, j + 1
    return sorted(found + added)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, n_markov, n_part, base_sha256, spans`` for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                every = [spans(x, threshold) for x in texts_of(part)]
                counts = [pa.array([sum(s[1] == k for s in x) for x in every], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(_joined(s for s in x if s[1] < 3).encode()).hexdigest() for x in every]
                yield pa.RecordBatch.from_arrays([part.column("id"), *counts, pa.array(sha, pa.string()), pa.array([_joined(x) for x in every], pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_markov", "n_part", "base_sha256", "spans"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, n_part long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_text(text: str, threshold: float = THRESHOLD, mark: str = "[REDACTED]") -> str:
    """The text with each secret (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans(text, threshold):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced; all rows and columns stay, null texts stay null."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [x if x is None else redact_text(x, threshold, mark) for x in part.column(text_col).to_pylist()]
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)
