"""Keys behind and before ordinary characters, in the scan and in the pipeline."""

import argparse
import ast
import asyncio
import decimal
import email
import http.client
import inspect
import logging
import multiprocessing
import random
import socket
import ssl
import string
import subprocess
import tarfile
import unittest
import zipfile

import corpus_pipeline
from marginalia.llm import secret_scan

KEYS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "upper": string.ascii_uppercase + string.digits, "lower": string.ascii_lowercase + string.digits, "url": string.ascii_letters + string.digits + "_-"}


def library_names():
    found = set()
    for module in (argparse, ast, asyncio, decimal, email, http.client, inspect, logging, multiprocessing, socket, ssl, subprocess, tarfile, unittest, zipfile):
        found |= {x for thing in [module, *vars(module).values()] for x in dir(thing)}
    return sorted(found)


def ordinary(rng, names, n):
    text = ""
    while len(text) < n:
        text += rng.choice(names) + rng.choice("__-/")
    return text[len(text) - n :]


def test_keys_among_ordinary_characters():
    """At most 5 % of 32-character keys are missed, whatever stands before and after; a key counts as found if three quarters of it are."""
    rng, names = random.Random(31), library_names()
    for kind, alphabet in KEYS.items():
        for before, after in ((0, 0), (7, 0), (20, 0), (60, 0), (0, 25), (40, 40)):
            missed = 0
            for _ in range(200):
                key = "".join(rng.choices(alphabet, k=32))
                text = ordinary(rng, names, before) + key + ordinary(rng, names, after)
                found = sum(max(0, min(e, before + 32) - max(s, before)) for s, _, e in secret_scan.spans(text))
                missed += found < 24
            assert missed <= 10, (kind, before, after, missed)


def test_ordinary_runs_are_left_alone():
    """At most 2 % of long names, none of runs of one character; few of paths of many names."""
    rng, names = random.Random(32), library_names()
    long = [x for x in names if len(x) >= secret_scan.LEAST]
    assert sum(bool(secret_scan.spans(x)) for x in long) <= 0.02 * len(long)
    assert not [c for c in string.ascii_letters + "-_=/+" for n in (20, 24, 40, 64) if any(k > 2 for _, k, _ in secret_scan.spans(c * n))]
    paths = ["/".join(rng.choices(names, k=rng.randint(3, 9))) for _ in range(1000)]
    assert sum(bool(secret_scan.spans(x)) for x in paths) <= 0.03 * len(paths)


def test_segments_against_brute_force():
    """The best segment of a run holds the sum that no other exceeds, where sums never fall far."""
    import numpy as np

    rng = random.Random(33)
    for _ in range(40):
        key = "".join(rng.choices(KEYS["base62"], k=rng.randint(24, 40)))
        text = f"client_configuration_{key}_value"
        x = np.clip(np.concatenate(list(secret_scan.ratios(text))), -secret_scan.CLIP, secret_scan.CLIP) - secret_scan.OFFSET
        sums = np.append(0, np.cumsum(x))
        best = max(sums[b] - sums[a] for a in range(len(x)) for b in range(a + 1, len(x) + 1))
        found = secret_scan.segments(text)
        if best >= secret_scan.SEGMENT + secret_scan.DROP:
            assert max((sums[b] - sums[a] for a, b in found), default=0) >= best - secret_scan.DROP
    assert secret_scan.segments("") == [] and secret_scan.segments("word_" * 20_000) == []


def test_pipeline_keeps_no_embedded_key(spark, frame):
    rng = random.Random(34)
    keys = ["".join(rng.choices(KEYS["base62"], k=32)) for _ in range(60)]
    heads = ["config_", "client_configuration_", "https_host_path_service_", "srv/app/data/", ""]
    rows = [(i, f"some words before {heads[i % 5]}{key} and after", "en", "s", 1) for i, key in enumerate(keys)] + [(100, None, "en", "s", 1), (101, "", None, None, None)]
    df = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.secret_redaction(spark, df, "").collect()}
    assert len(got) == 62 and got[100] is None and got[101] == ""
    kept = [k for i, k in enumerate(keys) if any(k[j : j + 16] in got[i] for j in range(17))]
    assert len(kept) <= 1 and all("words before" in got[i] and "and after" in got[i] for i in range(60))
