"""Windows of licence scans against a comparison of all windows, and long texts full of notices."""

import random
import re
import time

from marginalia.llm import licenses

THRESHOLD = licenses.THRESHOLD


def plain(text):
    """All rows of one text: every line and every window, with nothing left out early."""
    lines = [re.findall(r"[a-z0-9]+", x) for x in (text or "").lower().split("\n")]
    words, line_of = [w for x in lines for w in x], [k for k, x in enumerate(lines) for _ in x]
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    known = [(i, name, grams, low, high) for i, (name, grams, low, high) in enumerate(licenses.known())]

    def dice(grams, t):
        return 2.0 * len(grams & set(t[2])) / (len(grams) + len(t[2])) if t[3] <= len(grams) <= t[4] else 0.0

    g, out, fits, found = pairs(words), [], [], []
    for k, x in enumerate(lines):
        best = max(((dice(set(pairs(x)), t), -t[0], t[1]) for t in known), default=(0.0, 0, None))
        fits.append(best)
        if best[0] >= THRESHOLD:
            out.append((k, best[2], round(best[0], 6)))
    for t in known:
        at = [i for i, x in enumerate(g) if x in t[2]]
        found += [(-d, t[0], i, j, t[1]) for i in at for j in at if i <= j < i + 2 * t[4] and (d := dice(set(g[i : j + 1]), t)) >= THRESHOLD]
    kept = []
    for less, _, i, j, name in sorted(found):
        met = fits[line_of[i] : line_of[j + 1] + 1]
        if not any(f[0] >= THRESHOLD and (f[0] >= -less or f[2] == name) for f in met) and not any(a <= j + 1 and i <= b + 1 for a, b in kept):
            kept.append((i, j))
            out.append((line_of[i], name, round(-less, 6)))
    return sorted(out)


def test_all_windows(frame):
    rng = random.Random(8)
    texts = [t for _, t in licenses.TEMPLATES]
    rows = []
    for n in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(texts).split()
            a = rng.randint(0, len(words) // 4) if rng.random() < 0.4 else 0
            words = words[a : len(words) - (rng.randint(0, len(words) // 4) if rng.random() < 0.4 else 0)]
            if rng.random() < 0.5:
                words = [rng.choice(["foo", "license", "the"]) if rng.random() < 0.06 else w for w in words]
            if rng.random() < 0.3:
                words += words[: rng.randint(1, len(words))]
            parts += rng.choices(["foo", "bar", "the"], k=rng.randint(0, 3)) + words
        rows.append((n, "".join(w + ("\n" if rng.random() < 0.12 else " ") for w in parts)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "the MIT license. " * 30), (204, "released under the " * 40)]
    rows += [rows[0], rows[0]]
    got = sorted(tuple(r) for r in licenses.scan(frame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, g int")).collect())
    want = sorted((i, *x) for i, text in rows for x in plain(text))
    assert got == want and len({r[0] for r in got}) > 60


def test_long_texts_of_notices(spark):
    """Time in proportion to a text's notices: ten times the text takes at most some twenty times as long."""
    isc, took = dict(licenses.TEMPLATES)["isc"], []
    for n in (1, 40, 400):
        text = f"foo {isc}\nReleased under the\nMIT License. bar\n" * n
        began = time.perf_counter()
        found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        took.append(time.perf_counter() - began)
        assert len(found) == 2 * n
    assert took[2] < 20 * took[1] + 10
