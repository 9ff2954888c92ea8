"""The operators against brute force on small tables, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from civicloom.llm import automata, bpe, bwt, decontaminate, embedding_dedup, line_dedup, ngram_join, pii, quality, secrets
from civicloom.llm.components import components
from civicloom.operators import skew

SCHEMA = "doc_id bigint, text string, row string, value int, key string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def docs_of(spark, texts, start=0):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i + start, t, "x", 1, "k") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=5):
    """Copies, near copies, passages, periodic text, odd white space, nulls and empty texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgéñß日") for _ in range(rnd.randint(1, 7))) for _ in range(400)]

    def text(n):
        return "".join(w + rnd.choice([" ", " ", " ", "\n", ". ", ",\t", "  "]) for w in rnd.choices(words, k=n))

    passage, base = text(90), text(200)
    out = [None, "", " ", "one", "two words", text(1500), "ab " * 300, "ab " * 320, "x" * 1200]
    out += [text(60) + passage + text(rnd.randint(0, 80)) for _ in range(8)]
    out += [base] * 4
    for _ in range(6):
        near = base.split(" ")
        near[rnd.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [text(rnd.randint(3, 120)) for _ in range(20)] + ["\n".join([passage[:150], text(20), passage[:150]])]
    rnd.shuffle(out)
    return out


def test_pii(spark):
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]

    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    rnd = random.Random(1)
    parts = [*"ab@.+-0123456789 ()%_é日", "1.2.3.4", "@@", "4111 1111 1111 1111", "+1 (555) 010-2030", "a.b@c-d.org", "account no: 1234567"]
    texts = [None, "", *["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]]
    got = {r.doc_id: r for r in pii.report(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m[0]))
        spans = ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == sha(spans), (text, spans, got[i].spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w[1] == k for w in want) for k in range(4))
    assert pii.find("my account no: 1234567 and https://me:pw@host.org/x, 12 Long Lane")[0][0] == "account"
    assert {k for k, _, _ in pii.find("IBAN DE89 3704 0044 0532 0130 00 at 12 Green Street, ftp://me:pw@host/")} >= {"account", "address", "login"}


def test_secrets(spark):
    rnd = random.Random(2)
    keys = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    texts = [None, "", "Token: abc", "pass", *[f'see token = "{k}" here' for k in keys], "x" * 5000 + " API-KEY: secret=ABCDEF12 AKIA" + "A1" * 9]
    texts += [f"id {k[:16]}-{k[16:30]} Kpassword: zzzzzz" for k in keys[:5]] + ["tokKen=ABCDEFG secret:'abcdef'"]
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    got = {r.doc_id: r for r in secrets.report(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in p.finditer(text or "") if ok(m))
        spans = ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == sha(spans), (text, got[i])


def test_automaton_inference():
    """Merged states accept more of the same format, and little else."""
    rnd = random.Random(3)
    tree = secrets.Automaton()
    for _ in range(200):
        tree.add(secrets.symbols("AK-" + "".join(rnd.choice("0123456789ABC") for _ in range(rnd.randint(8, 16)))), 1)
    model = tree.merged(0.05)
    assert len(model.to) < len(tree.to) / 10
    assert model.score(secrets.symbols("AK-55AA31C200")) > model.score(secrets.symbols("ak_55aa31c200")) + 1


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors_brute(rows):
    n, comp = Counter(), {r[0]: r[0] for r in rows}

    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                x, y = (np.array(np.float32(v), float) for v in (a[1], b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    comp[max(p, q)] = min(p, q)
    return {k: (n[k], find(k)) for k in comp}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((centre + rng.standard_normal(16) * 0.05).tolist())
    rows = [(i, v, i % 3 if i % 50 else None) for i, v in enumerate(rows)]
    k = len(rows)
    rows += [(k + i, rows[0][1], rows[1][2]) for i in range(5)] + [(k + 5 + i, rows[7][1], rows[7][2]) for i in range(40)]
    rows += [(k + 50, None, 1), (k + 51, [0.0] * 16, 1), (k + 52, [float("nan")] + [1.0] * 15, 1), (k + 53, [None] + [1.0] * 15, 1), (k + 54, [float("inf")] * 16, 1), (k + 55, [], 1), (k + 56, [1.0, 2.0], 1)]
    schema = "vec_id bigint, embedding array<float>, label int, id string, vec int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    want = vectors_brute(rows)
    assert len(got) == len(rows)
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * links
    assert sum(got[i].component_id != c for i, (_, c) in want.items()) <= 0.05 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_codes_grow_with_rows():
    x = np.random.default_rng(8).standard_normal((500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, large = embedding_dedup.learn(x, 1000), embedding_dedup.learn(x, 10_000_000)
    assert large.bits > small.bits and large.tables > small.tables
    assert abs((small.of(x) >> 1 & 1).mean() - 0.5) < 0.1


def decontaminate_brute(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for k, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for k, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    found |= ids
                    hit[i : i + n] = [1] * n
        out.append((k, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_words", [decontaminate.SLICE_WORDS, 40])
def test_decontaminate(spark, slice_words):
    texts = corpus()
    items = [" ".join((t or "").split()[3:30]) for t in texts[:12]] + ["Ab", "ONE", None, "", "!?", "ab ab ab", "Ab AB ab ab ab ab ab ab ab ab ab"]
    bench = spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    docs = docs_of(spark, texts)
    spans, sizes = decontaminate.matches(docs, bench, slice_words=slice_words)
    got = sizes.join(decontaminate.hits(spans), "doc_id", "left").collect()
    want = decontaminate_brute(list(enumerate(texts)), [(100 + i, t) for i, t in enumerate(items)])
    got = sorted([(r.doc_id, r.n_words, r.n_hit or 0, len(r["items"] or []), sha(",".join(r["items"] or [])), bool(r.n_hit)) for r in got], key=str)
    assert got == want
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_decontaminate_null_ids(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(None, "x " + words), (None, words), (None, "clean"), (None, None), (big, words), (big + 1, "clean")], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(None, words), (7, words + " kilo")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect())
    hit = (10, 2, sha("7"), True)
    assert got == Counter({(None, 11, *hit): 1, (None, 10, *hit): 1, (big, 10, *hit): 1, (None, 1, 0, 0, sha(""), False): 1, (None, 0, 0, 0, sha(""), False): 1, (big + 1, 1, 0, 0, sha(""), False): 1})


def test_proximity(spark):
    item = [(1, "alpha bravo charlie delta echo foxtrot golf hotel india juliet")]
    texts = ["xx alpha bravo charlie delta echo foxtrot golf hotel india juliet", "alpha bravo charlie yy delta echo foxtrot golf hotel india juliet", "juliet alpha", "alpha bravo"]
    docs = docs_of(spark, texts)
    found, _ = decontaminate.matches(docs, spark.createDataFrame(item, "item_id bigint, text string"), slop=2)
    got = {r.doc_id: r.exact for r in found.collect()}
    assert got[0] is True and got.get(1) is False and 2 not in got


def ngram_brute(texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets, comp = [], list(range(len(texts)))
    for t in texts:
        w = word.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def chains(seed=11, groups=4, size=60):
    """Large groups of near copies: many pairs are near the threshold, on either side."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    out = []
    for _ in range(groups):
        base = rnd.choices(words, k=rnd.randint(30, 120))
        for _ in range(size):
            near = list(base)
            for _ in range(rnd.randint(0, max(2, len(base) // 18))):
                near[rnd.randrange(len(near))] = rnd.choice(words) + rnd.choice("xyz")
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("texts", [corpus(), chains()], ids=["corpus", "chains"])
def test_ngram_join(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "CROWD", 8)
    monkeypatch.setattr(ngram_join, "SALT", 5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(docs_of(spark, texts)).collect())
    assert got == ngram_brute(texts)


def test_ngram_join_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, "a b"), (2, text), (3, "A B"), (None, text), (None, None), (4, None), (5, "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    # the repeated id 2 ties both classes
    assert got == Counter([(1, 36, 1), (2, 1, 1), (2, 36, 1), (3, 1, 1), (None, 36, 1), (None, 0, None), (4, 0, 4), (5, 0, 5)])
    assert ngram_join.report(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_sketches_drop_no_link():
    rng = np.random.default_rng(3)
    linked = dropped = 0
    for _ in range(2000):
        n, more = int(rng.integers(1, 300)), int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(rng.integers(0, n + 1))], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        both = ngram_join.sketches(ngram_join.mix(np.concatenate([x, y])), np.array([0, len(x), len(x) + len(y)]))
        may = ngram_join.may_link(*[np.frombuffer(b, np.uint64) for b in both], 75)
        if ngram_join.link(x, y, 75):
            assert may
            linked += 1
        dropped += not may
    assert linked > 100 and dropped > 1000


def test_ngram_join_sends_whole_sets_of_likely_pairs_only(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
    passage = text(40)
    texts = [f"{passage} {text(60)}" for _ in range(12)] + [base := text(100), base + " more"]
    sent, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: sent.append(pairs.count()) or real(pairs, *rest))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(docs_of(spark, texts)).collect())
    assert got == ngram_brute(texts)
    # those with the passage share tokens, but only the last two texts are alike
    assert sum(sent) == 1


def test_ngram_join_leaves_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(skew, "checkpoint_folder", lambda spark: str(tmp_path))
    got = ngram_join.report(docs_of(spark, chains(groups=1, size=12)))
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    assert got.count() == 12


def bytes_brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for k, x in enumerate(raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if times[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(x), sum(gone), spans, sha(bytes(c for c, g in zip(x, gone) if not g))))
    return out


@pytest.mark.parametrize("length, gram", [(400, 160), (40, 12), (9, 4)])
def test_bytes(spark, length, gram, monkeypatch):
    monkeypatch.setattr(bwt, "BUCKET_BYTES", 4000)
    texts = corpus()
    got = bwt.dedup(docs_of(spark, texts), window=length, gram=gram).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got)
    assert got == bytes_brute(texts, length)


def test_bytes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(bwt, "SLICE_BYTES", 700)
    texts = corpus(9)
    got = bwt.dedup(docs_of(spark, texts), window=60, gram=20).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got) == bytes_brute(texts, 60)
    assert bwt.report(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_transform_merge():
    rnd = random.Random(7)
    for _ in range(200):
        letters = rnd.choice([b"ab", b"abc", b"\x00\xffa", b"a"])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 7))]
        length = rnd.choice([1, 2, 3, 5, 8])
        times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if times[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in bwt.repeated_starts(texts, length, rnd.choice([1, 2, 3]))] == want
        # common prefixes at the merged borders
        last = bwt.transform(texts)
        text, place = bwt.places(last, [len(t) for t in texts])
        suffixes = [texts[a][b:] for a, b in zip(text, place)]
        assert suffixes == sorted(suffixes)
        _, prefix = bwt.merge([last], length)
        for k in range(len(texts), len(suffixes)):
            a, b = suffixes[k - 1], suffixes[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == (same if same < length else -1)


def words_brute(texts, size):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    all_words = [word.findall(t or "") for t in texts]
    first, out = {}, []
    for k, w in enumerate(all_words):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), k)
    for k, w in enumerate(all_words):
        gone = [0] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [1] * size
        out.append((k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


@pytest.mark.parametrize("size, gram", [(50, 12), (12, 4), (5, 2)])
def test_words(spark, size, gram):
    texts = corpus()
    got = automata.dedup(docs_of(spark, texts), window=size, gram=gram).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == words_brute(texts, size)


def test_words_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, "")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in automata.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter({(1, 60, 0): 2, (2, 60, 60): 1, (None, 60, 60): 1, (None, 0, 0): 1, (3, 0, 0): 1})
    assert automata.report(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_automaton_firsts():
    rnd = random.Random(9)
    for _ in range(200):
        texts = [[rnd.randrange(3) for _ in range(rnd.randint(4, 30))] for _ in range(6)]
        found = automata.Automaton()
        for k, w in enumerate(texts):
            found.add(w, k)
        for w in texts:
            want = [next(k for k, v in enumerate(texts) if any(v[j : j + 4] == w[i : i + 4] for j in range(len(v) - 3))) for i in range(len(w) - 3)]
            assert found.firsts(w, 4) == want


def longest_ascending(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_alignment():
    rnd = random.Random(10)
    for _ in range(300):
        n = rnd.randint(0, 12)
        pairs = [(i, there, 1) for i, there in enumerate(rnd.sample(range(30), n))]
        gone = line_dedup.aligned(pairs, 0)
        assert len(gone) == longest_ascending(pairs)
        there = [pairs[i][1] for i in gone]
        assert gone == sorted(gone) and there == sorted(there)
    block = [(3, 7, 10), (4, 8, 15), (6, 9, 10)]
    assert line_dedup.aligned(block, 20) == [3, 4]


def test_line_dedup(spark):
    a = "\n".join(f"a line number {i} of the first" for i in range(6))
    texts = [a, "own words that nobody shares\n" + a, a, None, "", "\n \n", "short", "short", "new head line, quite long\n\n" + "\n".join(a.split("\n")[2:4]) + "\n\ntail of my own, long too"]
    texts += [f"filler text number {i}, long enough" for i in range(8)]
    got = {r.whole.doc_id: r for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert got[0].text == a and got[0].n_removed == 0
    assert got[1].text == "own words that nobody shares" and got[1].n_partners == 1
    assert got[2].text == "" and got[2].n_removed == got[2].n_lines == 6
    assert got[3].text is None and got[4].text == "" and got[5].text == "\n \n"
    assert got[7].text == "short"  # too short to delete
    assert got[8].text == "new head line, quite long\n\ntail of my own, long too"
    assert got[0].whole.row == "x"
    rows = [(1, a), (1, a), (None, a)]
    odd = Counter((r.doc_id, r.n_removed) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert odd == Counter({(1, 0): 2, (None, 6): 1})
    assert line_dedup.report(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_line_dedup_python_once(spark):
    """A text is cut once, also where the outcome is filtered, and only where a line may go; no stage chains Python steps."""
    odd = ["a\n\x1c\n\u3000 \n\x85\xa0\nb\u200b", "\n", "", None, " \r\n\u2028x\n\u180e", "\x0b\x0c", "\x00\n\ufeff"]
    odd += ["".join(map(chr, [9, 10, *range(28, 33)])) + f"\n{chr(c)}\n" for c in (*range(0x2000, 0x2030), 0x205F, 0x1680, 0xA0, 0x85)]
    found = line_dedup.dedup(docs_of(spark, [*odd, "one long line of text here, shared\nx", "one long line of text here, shared\ny"]))
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    steps = found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert steps == 3, steps
    got = {r.whole.doc_id: r for r in found.collect()}
    for i, text in enumerate(odd):
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == (sum(1 for x in (text or "").split("\n") if x.strip()), 0, text), text
    assert (got[len(odd) + 1].n_removed, got[len(odd) + 1].text) == (1, "y")


def test_line_dedup_other_holders(spark):
    """A block counts as a whole, whichever documents hold its lines first."""
    four = "short a\nshort b\nshort c\nshort d"
    texts = ["short a", "short b", four, four, "short d\nmine\n" + four + "\nshort d\ntail"]
    texts += [f"filler text number {i}, long enough" for i in range(8)]
    got = {r.whole.doc_id: r for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(5)] == [0, 0, 0, 4, 4]
    assert got[3].text == "" and got[4].text == "short d\nmine\nshort d\ntail"


def test_line_dedup_brute(spark):
    """Every block of consecutive lines that an earlier document has goes, if nothing stands in another order there."""
    rnd = random.Random(3)
    pool = [f"{'x' * rnd.randint(0, 9)} {i}" for i in range(30)]
    base = rnd.sample(pool, 12)
    docs = []
    for _ in range(60):
        i, j = sorted(rnd.sample(range(13), 2))
        docs.append(["own %d" % rnd.randrange(10**9), *base[i:j], "own %d" % rnd.randrange(10**9)])

    def common(a, b):
        gone = set()
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if sum(map(len, a[i : i + n])) >= line_dedup.MIN_CHARS:
                    gone |= set(range(i, i + n))
        return gone

    got = {r.whole.doc_id: r for r in line_dedup.dedup(docs_of(spark, ["\n".join(d) for d in docs]), rare_share=1.0).collect()}
    for k, d in enumerate(docs):
        gone = set().union(*[common(d, e) for e in docs[:k]]) if k else set()
        assert got[k].text == "\n".join(x for i, x in enumerate(d) if i not in gone), k


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_encoding(spark, vocabulary):
    t = bpe.tokenizer(vocabulary)
    rnd = random.Random(12)
    parts = ["a", "b", " ", "  ", "\n", "é", " ", "　", "\x85", "\x1c", "'re", "1", "!", "<|endoftext|>", "日本", "😀", "the", "\t", "\r\n", "<|end"]
    texts = [None, "", *["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]]
    texts += ["".join(rnd.choice(p) for _ in range(n)) for p, n in (("ab", 9000), ("é日", 3000), (" \n", 7000), ("0123", 6000), (["<|endoftext|>", "x"], 900), (["'re", "a"], 4000))]
    texts += ["head and " + "z" * 9000 + " tail\n" + "y" * 100, corpus()[0]]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs, vocabulary, leaf=512).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i].text == t.decode(ids, skip_special_tokens=False) == (text or ""), text
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.report(docs.limit(0), vocabulary).count() == 0


def test_encoding_repeated_rows(spark, vocabulary):
    rows = [(1, "q" * 5000), (1, "q" * 5000), (None, "q" * 5000), (None, None)]
    got = Counter((r.doc_id, r.n_tokens) for r in bpe.report(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary).collect())
    n = len(bpe.encode_text("q" * 5000, vocabulary))
    assert got == Counter({(1, n): 2, (None, n): 1, (None, 0): 1})


def test_field_marginals():
    """Forward-backward against all labellings."""
    rng = np.random.default_rng(13)
    nodes, edges = rng.standard_normal((7, 2)), rng.standard_normal((2, 2))
    first = np.array([0, 4, 5, 7])
    each, pairs, z = quality.marginals(nodes, edges, first)
    for k in range(3):
        rows = range(first[k], first[k + 1])
        weight = {}
        for labels in np.ndindex(*[2] * len(rows)):
            weight[labels] = np.exp(sum(nodes[r, y] for r, y in zip(rows, labels)) + sum(edges[a, b] for a, b in zip(labels, labels[1:])))
        total = sum(weight.values())
        assert np.isclose(z[k], np.log(total))
        for i, r in enumerate(rows):
            assert np.isclose(np.exp(each[r, 1]), sum(w for y, w in weight.items() if y[i]) / total)
    assert np.isclose(np.exp(pairs).sum(axis=(1, 2)), 1).all()


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "A line.\n" * 4000)], "doc_id bigint, text string")
    got = quality.report(odd, labels.limit(0)).collect()
    assert [r.score for r in got] == [0.5] * 4 and [r.predicted for r in got] == [1] * 4
    field = quality.fit(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")))
    scores = [r.score for r in quality.score(odd, field).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[1] == scores[2]
    assert quality.score(odd.limit(0), field).count() == 0
