import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickline.llm import fingerprints as fp

from .conftest import EDGES

TEXT = st.text("ab", max_size=40)


def hashed(text):
    return fp.PrefixHash(fp.code_points(text))


@given(TEXT, TEXT, st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
@settings(deadline=None)
def test_span_equality(a, b, i, j, n):
    inside = i + n <= len(a) and j + n <= len(b)
    assert fp.spans_equal(hashed(a), i, hashed(b), j, n) == (inside and a[i : i + n] == b[j : j + n])


@given(TEXT, TEXT, st.integers(0, 5), st.integers(0, 5))
@settings(deadline=None)
def test_common_extension(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert fp.common_extension(hashed(a), i, hashed(b), j) == want


@given(st.text(min_size=6, max_size=60), st.integers(1, 6))
@settings(deadline=None)
def test_windows_hash_alike_wherever_they_stand(text, width):
    windows = hashed(text).windows(width)
    spans = [text[i : i + width] for i in range(len(text) - width + 1)]
    assert len(windows) == len(spans) and len(set(windows.tolist())) == len(set(spans))
    moved = hashed("xyz" + text).windows(width)[3:]
    assert (moved == windows).all()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def share(a, b):
    """Likeness by plain sets: of the smallest hashes of either, those of both."""
    if a == b:
        return 1.0
    x, y = ({h[i : i + 16] for i in range(0, len(h), 16)} for h in (f.rpartition(":")[2] for f in (a, b)))
    smallest = sorted(x | y)[: fp.KEEP]
    return sum(h in x and h in y for h in smallest) / len(smallest) if x and y else 0.0


def check(got, rows):
    got, rows = list(got), ordered(rows)
    near = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        own, other, behind = (fp.fingerprint(hashed(t)) for t in (text, new, following))
        near.append((doc, round(share(own, other), 9), round(share(own, behind), 9)))
    assert sorted(map(str, near)) == sorted(str((r.doc_id, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
    want = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.fingerprint(hashed(text)), fp.fingerprint(hashed(new))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)) for r in got)


@pytest.mark.parametrize("per_stretch", [4000, 3, 1])
def test_edits_across_stretches(documents, per_stretch):
    rows = [*EDGES, *[(50 + 3 * i, f"text {i} " * (i % 9)) for i in range(40)]]
    random.Random(1).shuffle(rows)
    got = fp.fingerprint_documents(documents(rows).repartition(5), rows_per_stretch=per_stretch).collect()
    check(got, [r[:2] for r in rows])


def test_single_document_follows_itself(documents):
    got = fp.fingerprint_documents(documents([(1, "abcdefgh")])).first()
    assert got.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and got.near_next == 1.0
    assert fp.fingerprint_documents(documents([(1, "a")]).limit(0)).collect() == []


def test_many_stretches_are_looked_up_in_two_steps(spark):
    from pyspark.sql import functions as F

    cuts = list(range(10, 3000, 10))
    reached = fp._search(cuts, width=7)
    rows = spark.range(-5, 3100).select("id", reached(F.col("id")).alias("n")).collect()
    assert all(r.n == sum(c <= r.id for c in cuts) for r in rows)


def test_likeness_tells_edits_from_strangers():
    random.seed(5)
    texts = ["".join(random.choices("abcdefghij ", k=random.choice([200, 2000, 20_000]))) for _ in range(30)]
    for a, b in zip(texts, texts[1:]):
        one, other, new = (fp.fingerprint(hashed(t)) for t in (a, b, fp.edited(a, b)))
        assert fp.likeness(one, one) == 1 and fp.likeness(one, other) < 0.1 and 0.4 < fp.likeness(one, new) < 0.95
    assert fp.likeness(fp.fingerprint(hashed("")), fp.fingerprint(hashed(""))) == 1
    assert fp.likeness(fp.fingerprint(hashed("")), fp.fingerprint(hashed("a"))) == 0
