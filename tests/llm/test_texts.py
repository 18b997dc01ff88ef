"""Row-wise operators: token counts, packing, secrets, licences, decontamination."""

import argparse
import ast
import asyncio
import collections
import decimal
import email
import errno
import hashlib
import http.client
import inspect
import logging
import multiprocessing
import os
import random
import re
import signal
import socket
import ssl
import string
import subprocess
import tarfile
import textwrap
import tracemalloc
import unittest
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import decontaminate, licenses, packing, secret_scan, token_counts
from marginalia.llm.pieces import PieceEncoder

ALPHABET = "ab Z.\n'é\t<|>end 1²ÿΣ ́日\x1c "
SPECIAL = ["", "  ", " a  b\n\n c \n", "a<|endoftext|> b <|endoftext|>", "ΣΑΣ İst", "don't I'LL we're 's", "²³ ½ ª º", "a" * 3000, "\x1c a\x1cb \x85c", "<|startoftext|>hi", "trail   "]


def texts(n=800):
    rng = random.Random(0)
    return SPECIAL + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_library(name):
    path, some = public_tokenizers.path(name), texts()
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    coder = PieceEncoder(path, limit=300)  # forgets now and then
    for a in range(0, len(some), 100):
        ids, bounds = coder.encode(some[a : a + 100])
        assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(bounds) - 1)] == want[a : a + 100]
        assert coder.count(some[a : a + 100]).tolist() == [len(x) for x in want[a : a + 100]]


def test_token_counts(odd_docs, frame):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(odd_docs, path).collect()}
    for r in odd_docs.collect():
        text = r.text or ""
        got = rows[r.doc_id, len(text.encode())]
        assert got.n_tokens == len(library.encode(text, add_special_tokens=False).ids) and got.over_limit == (got.n_tokens > 1024)
    assert token_counts.count_tokens(frame([], "doc_id long, text string", 1), path).count() == 0
    model = token_counts.count_tokens(odd_docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert model.where("n_tokens > 0").count() > 0


def test_packing(odd_docs, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat"], k=rng.choice([0, 3, 50, 900, 4095, 5000, 9000])))) for i in range(60)]
    found = packing.pack(frame(rows, "doc_id long, text string"), path).collect()
    for i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine[:-1])]).tolist()
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) and r.length == len(r.ids)
    fills = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 and n < 4096 for n in fills.values())
    assert packing.pack(odd_docs, path).count() >= 8
    assert packing.pack(frame([], "doc_id long, text string", 1), path).count() == 0


def test_sum_of_squares_choice():
    """The level array against the sums of squares of all placements: whole, in a new window, or cut."""
    rng = random.Random(6)
    for _ in range(600):
        p = packing.Packer(24, 2, 4)
        fills = [rng.randint(1, 22) for _ in range(rng.choice([0, 1, 4, 12]))]
        for f in fills:
            p._put(f, [])
        size = rng.randint(1, 23)
        squares = lambda fs: sum(c * c for c in collections.Counter(-(-f // 2) for f in fs).values())
        can = {0: squares([*fills, size])}
        for level in set(-(-f // 2) for f in fills):
            top = p.open[level][-1][0]
            rest = [*fills]
            rest.remove(top)
            end = top + size
            can[level] = squares([*rest, end] if end < 24 else rest if end == 24 else [*rest, end - 24]) + 4 * (end > 24)
        assert can[p._best(size)] == min(can.values())


def test_few_tokens_are_moved():
    """Also in small partitions nearly all tokens lie where they were placed; windows stay few whatever the sizes."""
    rng = random.Random(8)
    for sizes, share in (([rng.randint(1, 60) ** 2 for _ in range(240)], 0.02), ([rng.randint(1, 60) ** 2 for _ in range(5000)], 0.005), ([rng.randint(2100, 4000) for _ in range(2000)], 0.03), ([3000] * 1000, 0.01)):
        p, out, most = packing.Packer(), [], 0
        for i, n in enumerate(sizes):
            out += p.add(i, np.arange(n, dtype=np.uint32))
            most = max(most, int(p.count.sum()))
        out += p.finish()
        assert sorted((d, int(x)) for d, _, ids, *_ in out for x in ids) == [(i, x) for i, n in enumerate(sizes) for x in range(n)]
        fills = collections.Counter()
        for _, at, ids, sequence, offset, _ in out:
            assert offset == fills[sequence] and ids[0] == at
            fills[sequence] += len(ids)
        assert sum(n < 4096 for n in fills.values()) <= 12 and all(n == 4096 or n & (n - 1) == 0 for n in fills.values())
        assert p.moved <= share * sum(sizes) and most < 200, (p.moved / sum(sizes), most)


def plain_spans(text):
    out = []
    for kind, pattern, least, group in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (1, "AKIA[A-Z0-9]+", 20, 0), (2, "[0-9a-f]+", 24, 0)):
        for m in re.finditer(pattern, text, re.ASCII | re.IGNORECASE if kind == 0 else 0):
            if len(m[group]) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_secrets(odd_docs):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "Secret", ":", "=", " ", '"', "AKIA", "ABCDEF0123456789XY", "0123456789abcdef" * 2, "abc", "x.y=z", "é", "\n", "ſecret=abcdefgh", "toKen=abcdefgh"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert [s for s in secret_scan.spans(text) if s[1] < 3] == plain_spans(text), text
    rows = {r.doc_id: r for r in secret_scan.scan(odd_docs).collect()}
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].spans == ""


def test_markov():
    random_ones = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"]
    ordinary = ["getUserAccountSettingsFromDatabase", "the_quick_brown_fox_jumps_over_2024", "--------------------------", "Donaudampfschifffahrtsgesellschaft", "internationalization_localization", "00000000000000000000"]
    assert all(secret_scan.llr(x) > secret_scan.THRESHOLD for x in random_ones)
    assert all(secret_scan.llr(x) < secret_scan.THRESHOLD for x in ordinary)
    assert secret_scan.redact_text(f"key {random_ones[0]} and password=abcdef12!") == "key [REDACTED] and [REDACTED]!"


def test_markov_beside_patterns():
    random_one, digits = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAM", "0123456789abcdef01234567"
    assert secret_scan.spans(f"{random_one}_{digits}") == [(0, 3, 33), (33, 2, 57)]
    assert secret_scan.spans(f"{digits}_{random_one}") == [(0, 2, 24), (24, 3, 57)]
    assert secret_scan.spans(f"{random_one}_{digits}_{random_one}") == [(0, 3, 33), (33, 2, 57), (57, 3, 90)]
    assert secret_scan.spans(f"the_quick_brown_fox_jumps_{digits}") == [(26, 2, 50)]
    assert secret_scan.redact_text(f"x {random_one}_{digits} y") == "x [REDACTED][REDACTED] y"


def test_markov_rates():
    """On strings the models were not trained on: random ones by alphabet, and long names of the standard library."""
    rng, miss = random.Random(99), {}
    for kind, alphabet in (("base62", string.ascii_letters + string.digits), ("base64", string.ascii_letters + string.digits + "+/"), ("upper", string.ascii_uppercase + string.digits), ("lower", string.ascii_lowercase + string.digits)):
        found = [secret_scan.llr("".join(rng.choices(alphabet, k=rng.randint(24, 60)))) > secret_scan.THRESHOLD for _ in range(500)]
        miss[kind] = 1 - sum(found) / len(found)
    names = set()
    for module in (argparse, ast, asyncio, decimal, email, errno, http.client, inspect, logging, multiprocessing, os, signal, socket, ssl, subprocess, tarfile, unittest, zipfile):
        names |= {x for thing in [module, *vars(module).values()] for x in dir(thing) if len(x) >= secret_scan.LEAST}
    false = sum(secret_scan.llr(x) > secret_scan.THRESHOLD for x in names) / len(names)
    assert len(names) > 300 and false <= 0.02 and max(miss.values()) <= 0.1, (false, miss)


def test_many_spans_in_one_text():
    """One pass over spans and candidates: many of both, against a comparison of all with all."""
    rng = random.Random(3)
    parts = ["0123456789abcdef01234567", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAM", "_", " ", "token=abcdefgh", "the_quick_brown_fox_jumps_over"]
    for n in [*[rng.randint(1, 30) for _ in range(300)], 40_000]:
        text = "".join(rng.choices(parts, k=n))
        found = secret_scan.spans(text)
        base = [x for x in found if x[1] < 3]
        covered = np.zeros(len(text) + 1, np.int64)
        np.add.at(covered, [a for a, _, _ in base], 1)
        np.add.at(covered, [b for _, _, b in base], -1)
        free = np.append(np.cumsum(covered)[:-1] == 0, False)
        want = []
        for m in secret_scan.CANDIDATE.finditer(text):
            at = m.start()
            for p in range(m.start(), m.end() + 1):
                if p == m.end() or not free[p]:
                    if p - at >= secret_scan.LEAST and secret_scan.llr(text[at:p]) > secret_scan.THRESHOLD:
                        want.append((at, 3, p))
                    at = p + 1
        assert [x for x in found if x[1] == 3] == want
    assert secret_scan.llr(parts[1] * 5000) == pytest.approx(secret_scan.llr(parts[1] * 5000, block=1 << 30))


def test_redact(odd_docs):
    got = secret_scan.redact(odd_docs)
    assert got.schema == odd_docs.schema and sorted(map(str, got.collect())) == sorted(map(str, odd_docs.collect()))


def test_licenses(frame, odd_docs):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "RELEASED under the -- MIT license"), (3, "nothing here\nto see"), (4, None), (5, "All rights reserved.\nAll rights reserved.")]
    got = {(r.doc_id, r.line): (r.license, r.dice) for r in licenses.scan(frame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1): ("apache-2.0", 1.0), (2, 0): ("mit", 1.0), (5, 0): ("all-rights-reserved", 1.0), (5, 1): ("all-rights-reserved", 1.0)}
    assert licenses.scan(odd_docs).count() == 0


def test_license_windows(frame):
    full = dict(reversed([(name, text) for name, text in licenses.TEMPLATES if len(text) > 100]))
    wrapped = {name: "\n".join(textwrap.wrap(text, 72)) for name, text in full.items()}
    rows = [(i, f"some words before\n# {text.replace(chr(10), chr(10) + '# ')}\nand some more after") for i, text in enumerate(wrapped.values())]
    rows += [(50, "x Released under the MIT License. All rights reserved."), (51, "x\nLicensed under the\nMIT License. y"), (52, "All rights are reserved under the sun, the license of many words"), (53, None), (54, "")]
    got = [tuple(r) for r in licenses.scan(frame(rows, "doc_id long, text string")).collect()]
    want = [(i, 1, name, 1.0) for i, name in enumerate(wrapped)]
    want += [(50, 0, "mit", 1.0), (50, 0, "all-rights-reserved", 1.0), (51, 1, "mit", 1.0)]
    assert sorted(got) == sorted(want)


def windows(text, n):
    w = [x.decode() for x in decontaminate.words(text or "")]
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1) if w else 0)]


def test_fm_index():
    rng = random.Random(1)
    for _ in range(40):
        alphabet = ["a", "b", "c", "dd", "É", "9"][: rng.randint(1, 6)]
        docs = [" ".join(rng.choices([*alphabet, "zz"], k=rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        docs += docs[:2]
        items = [(str(i), " ".join(rng.choices(alphabet, k=rng.randint(0, 8)))) for i in range(rng.randint(0, 8))]
        n = rng.randint(1, 5)
        owners = {}
        for item, text in items:
            for k in windows(text, n)[1]:
                owners.setdefault(k, set()).add(item)
        phrases = decontaminate.Phrases(items, n)
        counts, spans, found = decontaminate.search_shard(docs, phrases)
        for most in (1, 7, 40):  # texts in pieces
            again = decontaminate.search_shard(docs, phrases, most)
            assert again[0].tolist() == counts.tolist() and again[1:] == (spans, found)
        for text, count, span, names in zip(docs, counts, spans, found, strict=True):
            w = windows(text, 1)[0]
            hit, mine = set(), set()
            for size in {len(k) for k in owners}:
                for i in range(len(w) - size + 1):
                    if tuple(w[i : i + size]) in owners:
                        hit |= set(range(i, i + size))
                        mine |= owners[tuple(w[i : i + size])]
            assert (count, {x for a, b in span for x in range(a, b)}, names) == (len(w), hit, sorted(mine))


def test_phrases_are_small(rng):
    """What is broadcast stays near the items' own size."""
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(rng.choices(words, k=400))) for i in range(400)]
    tracemalloc.start()
    phrases = decontaminate.Phrases(items)
    built, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(phrases.starts) == 400 * 388 and max(built, peak) < 6 * sum(len(x) for _, x in items)


def test_decontaminate(frame, odd_docs):
    passage = " ".join(f"q{i}" for i in range(20))
    bench = frame([(7, passage), (8, "Only four words here"), (8, "only FOUR words, here!"), (9, None), (None, "again and again and again")], "item_id long, text string", 1)
    docs = frame([(1, f"x {passage.upper()} y"), (2, "z " * 500 + passage), (3, "clean"), (4, "say: only four words; here"), (5, None)], "doc_id long, text string")
    whole = decontaminate.digest(decontaminate.find(docs, bench)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in whole}
    assert got == {1: (22, 20, 1, True), 2: (520, 20, 1, False), 3: (1, 0, 0, False), 4: (5, 4, 1, True), 5: (0, 0, 0, False)}
    blocks = decontaminate.digest(decontaminate.find(docs, bench, block_bytes=40)).collect()
    assert sorted(blocks) == sorted(whole)
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3, 5}
    clashing = docs.selectExpr("doc_id", "text", "doc_id as row", "-doc_id as _ROW")
    for bytes_at_once in (40, 10**6):
        kept = decontaminate.drop_contaminated(clashing, bench, block_bytes=bytes_at_once)
        assert kept.columns == clashing.columns and sorted(map(tuple, kept.collect()), key=str) == [(2, *[r.text for r in docs.where("doc_id = 2").collect()], 2, -2), (3, "clean", 3, -3), (5, None, 5, -5)]
    found = {r.doc_id: r for r in decontaminate.find(docs, bench).collect()}
    assert [(s.start, s.end) for s in found[4].chars] == [(5, 26)]
    assert decontaminate.drop_contaminated(odd_docs, bench).count() == 8
    assert decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0
