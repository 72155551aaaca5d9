import hashlib
import re

import numpy as np

import lines
from loomstone.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits(m)))]
        if 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in d) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_rules_equal_the_patterns():
    r = np.random.default_rng(8)
    pool = ["a", "b1", ".", "@", "-", "_", "1", "23", "255", "256", " ", "+", "(", ")", "é", "4111111111111111", "5555 5555 5555 4444", "192.168.0.1", "..", "@@", "%", "+1 555", "007"]
    for _ in range(20_000):
        t = "".join(pool[int(i)] for i in r.integers(0, len(pool), size=int(r.integers(1, 25))))
        assert pii.base_spans(t) == brute(t), t


def test_boosted_trees_on_lines_they_have_not_seen():
    trees = pii.train()
    rows = pii.generated(3000, 77)
    score = trees.score(np.array([pii.describe(t, c) for t, c, _ in rows]))
    y = np.array([r[2] for r in rows])
    hit = np.array([s >= trees.threshold[r[1][2]] for s, r in zip(score, rows, strict=True)])
    assert y[hit].mean() > 0.97 and hit[y == 1].mean() > 0.85


def test_trees_on_lines_written_by_hand():
    trees = pii.train()
    for private, clean in ((lines.FIRST_PRIVATE, lines.FIRST_CLEAN), (lines.SECOND_PRIVATE, lines.SECOND_CLEAN)):
        found = [any(s[2] == kind for s in pii.all_spans(text, trees)[1]) for text, kind in private]
        assert np.mean(found) >= 0.9, [p for p, ok in zip(private, found, strict=True) if not ok]
        wrong = [text for text in clean if pii.all_spans(text, trees)[1]]
        assert len(wrong) <= 1, wrong


def test_boosting_equals_a_plain_search_for_splits():
    """The first tree of one level against all cuts of all features."""
    r = np.random.default_rng(9)
    x = np.round(r.standard_normal((200, 3)), 1)
    y = (x[:, 1] + 0.3 * r.standard_normal(200) > 0.2).astype(float)
    tree = pii.boost(x, y, rounds=1, depth=1, rate=1.0, ridge=1.0, bins=10_000)
    p = (y.mean() + 1e-6) / (1 + 2e-6)
    g, h = p - y, np.full(200, p * (1 - p))
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, j] <= c, x[:, j] > c)), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1])
    j, c = tree.feature[0, 0], tree.cut[0, 0]
    got = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, j] <= c, x[:, j] > c))
    assert j == best[1] == 1 and got >= 0.99 * best[0]
    left = x[:, j] <= c
    assert np.allclose(tree.leaf[0], [-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)], rtol=1e-3)


def test_overlapping_candidates_give_way_to_better_ones():
    trees = pii.train()
    r = np.random.default_rng(11)
    parts = ["password=", "abc123def456ghi", '"', " ", "ssn 219-09-9999", "415-555-0132", "x (at) y (dot) com", "DE89 3704 0044 0532 0130 00", "10.0.0.1", "a@b.co", "é", "\n", ": ", "4111 1111 1111 1111", "commit ", "9f8d7c6b5a4e3d2c1b0a9f8e7d6c5b4a"]
    for _ in range(300):
        text = "".join(parts[int(k)] for k in r.integers(0, len(parts), size=int(r.integers(2, 12))))
        base, every = pii.all_spans(text, trees)
        offered = pii.candidates(text)
        score = dict(zip(offered, trees.score(np.array([pii.describe(text, c) for c in offered])).tolist(), strict=True)) if offered else {}
        taken = list(base)
        for c in sorted((c for c in offered if score[c] >= trees.threshold[c[2]]), key=lambda c: -score[c]):
            if all(c[1] <= s or e <= c[0] for s, e, _ in taken):
                taken.append(c)
        assert sorted(taken, key=lambda s: (s[0], pii.ORDER[s[2]])) == every, text


def test_no_character_of_a_long_secret_stays():
    trees = pii.train()
    r = np.random.default_rng(12)
    for n in (300, 5000, 200_000):
        key = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
        for text in (f'password = "{key}" and so on', f"api_key={key}", f"my secret: {key}."):
            left = pii.redacted(text, pii.all_spans(text, trees)[1])
            assert len(left) < 60 and not any(key[k : k + 12] in left for k in range(0, n - 12, max(1, n // 500))), (n, left[:80])
    assert pii.checked("DE89 3704 0044 0532 0130 00") == 1 == pii.checked("GB29NWBK60161331926819")


def test_extra_spans_and_redaction():
    trees = pii.train()
    text = 'mail me@x.org, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and +1 (974) 555-3436 commit'
    base, every = pii.all_spans(text, trees)
    assert [s[2] for s in base] == ["email", "phone"] and [s[2] for s in every] == ["email", "secret", "phone"]
    assert pii.redacted(text, every) == 'mail <EMAIL>, token = "<SECRET>" and <PHONE> commit'
    assert pii.all_spans("The plain words of a clean text, number 12345 and version 1.2.3 of 2024-01-05.", trees) == ([], [])
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000):
        pii.all_spans(t, trees)


def test_long_secrets_are_found_whole():
    trees = pii.train()
    r = np.random.default_rng(5)
    mixed = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    for n in (150, 201, 400, 512, 513, 1600, 50_000):
        key = "".join(r.choice(mixed, n))
        assert pii.candidates(f"see {key} here") == [(4, 4 + n, "secret")]
        for text in (f'secret = "{key}" end', f"my private key: {key} end"):
            assert key[-20:] not in pii.redacted(text, pii.all_spans(text, trees)[1]), (n, text[:20])
            assert pii.redacted(text, pii.all_spans(text, trees)[1]) == text.replace(key, "<SECRET>")
    t = "secret=" * 20_000 + "a1" * 20
    assert len(pii.candidates(t)) == 20_000  # the last name and the token propose the same span
    assert pii.redacted(t, pii.all_spans(t, trees)[1]).count("a1") == 0


def test_queries(spark):
    rows = [(1, "é a@b.co 10.0.0.1", 3), (2, None, None), (3, "", 0), (3, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, pii.find(df).collect()))
    spans = "email:2:8,ip:9:17"
    assert got[0] == (1, 1, 1, 0, 0, sha(spans), spans, 2) and got[1:] == [(i, 0, 0, 0, 0, sha(""), "", 0) for i in (2, 3, 3)]
    odd = spark.createDataFrame([(None, "a@b.co", 1, "x"), (4, "", 2, "y")], "doc_id long, text string, n_email int, spans string")
    assert sorted(map(tuple, pii.redact(odd).collect()), key=str) == [(4, "", 2, "y"), (None, "<EMAIL>", 1, "x")]
    assert {r["doc_id"]: r["n_email"] for r in pii.find(odd).collect()} == {None: 1, 4: 0}
    assert sorted(map(tuple, pii.redact(df).collect()), key=str)[0] == (1, "é <EMAIL> <IP>", 14)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
