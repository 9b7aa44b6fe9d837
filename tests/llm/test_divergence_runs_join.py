"""The source audit, the periodic runs and the similarity join against plain versions, on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import divergence, jaccard_join, perfect_hash, runs
from tandem.llm.words import LETTERS, LOWER, PLAIN, cut, pieces

SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, gid long, slot long, hub long, short string, bin int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
PHRASES = ["alpha beta gamma", "ALPHA Beta-gamma", "été naïve Ünder", "x1y2z3 x y z", "a\x00b [c]^d", "beta beta beta"]


def texts(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(PHRASES) for _ in range(rng.randrange(0, 12)))
        out.append((i, text, rng.choice(["en", "fr", None, "", "xx"]), rng.choice(["s", "t", None, "", "é", "one"])))
    out += [(3, "solo words here", "zz", "only"), (None, None, None, None), (5, "", "en", "quiet"), (6, " \t", "qq", "r"), (7, LONG, "en", "s")]
    out += [out[0], out[0], (8, "common common", "zz", "other"), (9, "common", "zz", "only"), (10, "common", "zz", "only")]
    return [(*row, True, 1, 2, 3, "c", 4) for row in out]


def audit(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """The contract, word for word, in Python numbers."""
    docs = []
    for _, text, lang, source, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        docs.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    held = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    groups = sorted({d[:2] for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in held.items() if x == lang and n >= least]
        own = [s for x, s in groups if x == lang]
        count = {s: Counter(t for x, y, terms in docs if (x, y) == (lang, s) for t in terms) for s in own}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(count[s]) for s in own}, share(sum(count.values(), Counter()))
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("shard_terms", "round_bytes", "top"), [(4, 60, 3), (100, 1 << 20, 200)])
def test_audit(spark, shard_terms, round_bytes, top):
    rows = texts(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.source_divergence(docs, 3, top, shard_terms, round_bytes)
    assert sorted(tuple(r) for r in got.collect()) == audit(rows, 3, top)


def test_audit_without_rows_or_terms(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x", "en", "a", True, 1, 1, 1, "", 1), (2, None, "en", "b", True, 1, 1, 1, "", 1)]
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_audit_adds_up_in_small_parts(spark, monkeypatch):
    rows = texts(2)
    for name, value in (("GATHERED", 5), ("_CELLS", 7), ("_PIECE", 50)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(rows, SCHEMA).select("text", "lang", "source").repartition(2)
    batches = pa.Table.from_pandas(docs.na.fill("").toPandas(), preserve_index=False).to_batches()
    kept = Counter()
    for batch in divergence._held(iter(batches)):
        for lang, term, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept[lang, term] += n
    plain = Counter()
    for _, text, lang, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        plain.update({(lang or "", t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)})
    assert kept == plain


def test_shares_are_exact():
    counts = np.array([0, 1, 10**6, 10**13, 4 * 10**15 - 2], np.int64)
    for total in (1, 7, 10**9 + 1, 4 * 10**15 + 3):
        fits = counts < total
        want = [1 + 10**9 * (int(c) + 1) // total for c in counts[fits]]
        assert divergence.shares(counts[fits], total).tolist() == want


def shard(keys: list[bytes], seed: int) -> perfect_hash.Shard:
    turn, sizes, bits, order = perfect_hash.build(keys, seed)
    keys = [keys[i] for i in order]
    ends = np.cumsum([len(k) for k in keys]).astype("<i4").tobytes()
    return perfect_hash.Shard("g", seed, seed, turn, sizes, bits, b"".join(keys), ends)


def test_perfect_hash(monkeypatch):
    real = perfect_hash.key_hashes

    def poor(keys, seed):  # the first seed's hashes collide
        return real(keys, seed) % np.uint64(50) if seed == 2 else real(keys, seed)

    monkeypatch.setattr(perfect_hash, "key_hashes", poor)
    shards = [shard([f"{s}-{i}".encode() for i in range(n)], s) for s, n in ((1, 3000), (2, 200), (3, 1))]
    assert shards[1].turn == 1
    table = perfect_hash.ShardedHash(shards)
    for s, n in ((1, 3000), (2, 200), (3, 1)):
        keys = [f"{s}-{i}".encode() for i in range(n + 500)]
        found = table.slots(pa.array(keys, pa.binary()), np.full(len(keys), s - 1), poor(keys, s))
        first = table.firsts[s - 1]
        assert sorted(found[:n].tolist()) == list(range(first, first + n)) and (found[n:] == -1).all()
    assert (table.slots(pa.array([b"a"]), np.array([-1]), np.zeros(1, np.uint64)) == -1).all()


def test_cut():
    given = ["", None, " a  b", "c", "\x0bÄ É ß x1Y", "d ", "e"]
    for array in (pa.array(given), pa.array(["junk junk", *given]).slice(1), pa.array([], pa.string())):
        want = [(t or "").encode().split() for t in array.to_pylist()]
        words, counts = cut(array, PLAIN)
        assert words.to_pylist() == [w for own in want for w in own] and counts.tolist() == [len(w) for w in want]
        assert cut(array, LOWER)[0].to_pylist() == [w.lower() for own in want for w in own]
    assert cut(pa.array(["x1Y é-Z_[q]"]), LETTERS)[0].to_pylist() == ["x".encode(), b"y", "é".encode(), b"z", b"q"]
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "d" * 9, "", "e"])], ["text"])
    assert [b.num_rows for b in pieces(iter([batch]), most=4)] == [3, 2]


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every diagonal of every lag, one word at a time."""
    least: dict[tuple[int, int], int] = {}
    for lag in range(1, len(words) // 3 + 1):
        at = lag
        while at < len(words):
            start = at
            while at < len(words) and words[at] == words[at - lag]:
                at += 1
            if at - start + lag >= max(24, 3 * lag):
                least.setdefault((start - lag, at - start + lag), lag)
            at += at == start
    return sorted((s, n, q) for (s, n), q in least.items())


def looping(seed: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(80):
        kinds, words = rng.choice([1, 2, 3, 40]), []
        while len(words) < rng.choice([0, 5, 40, 200, 500]):
            if rng.random() < 0.5:
                words += [f"v{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 30))]
            else:
                unit = [f"v{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 60))]
                words += (unit * rng.randrange(2, 9))[: rng.randrange(1, 300)]
        out.append(" ".join(words))
    return out


def test_runs(spark):
    given = [*looping(4), "", None, " \n ", "same " * 30_000, LONG, " ".join(map(str, [*range(23), *range(23), *range(22)])), *["a b c " * 9] * 2]
    rows = [(i if i != 3 else None, t, "en", "s", True, 1, 1, 1, "", 1) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.doc_id, r.n_words): r for r in runs.periodic_runs(docs).collect()}
    found = 0
    for i, text in enumerate(given):
        words = (text or "").split()
        row = got[(i if i != 3 else None, len(words))]
        want = plain_runs(words) if len(words) < 25_000 else [(0, len(words), 1)]
        assert [tuple(r) for r in row.runs] == want
        found += len(want)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (tuple(row.strongest) if row.strongest else None) == best
    assert found > 30
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least=10)


def test_runs_of_reordered_words(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f"), (None, "g")], "doc_id long, text string")

    def twice(doc_id, n):
        return np.arange(40) % n if doc_id == 1 else None

    got = {r.doc_id: r for r in runs.periodic_runs(docs, reorder=twice).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 40, 4)] and got[1].n_words == 40 and got[1].collapsed == "a b c d"
    assert got[2].collapsed == "e f" and got[None].collapsed == "g"


def plain_components(rows: list[tuple], percent: int, n: int) -> list[tuple]:
    sets = []
    for _, text, *_ in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset())
    above: dict[int, int] = {}

    def root(x: int) -> int:
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    holders, known = defaultdict(list), [i for i, row in enumerate(rows) if row[0] is not None and sets[i]]
    for i in known:
        for g in sets[i]:
            holders[g].append(i)
    for i in known:
        shared = Counter(j for g in sets[i] for j in holders[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                above[b] = a
    return sorted((row[0] or -1, len(s), root(row[0]) if row[0] is not None else -1) for row, s in zip(rows, sets, strict=True))


def edited(seed: int) -> list[tuple]:
    """Families of copies with a few words changed, of many sizes, and a chain that no single text is near to."""
    rng, out = random.Random(seed), []
    for size in (3, 9, 10, 12, 20, 40, 90, 300):
        for _ in range(3):
            words = [f"w{rng.randrange(5000)}" for _ in range(size + rng.randrange(3))]
            for _ in range(8):
                own = list(words)
                for _ in range(rng.randrange(0, size // 30 + 2)):
                    own[rng.randrange(len(own))] = f"n{rng.randrange(10**9)}"
                out.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    words = [f"c{i}" for i in range(200)]
    for _ in range(120):
        words[rng.randrange(200)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(words))
    rng.shuffle(out)
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("percent", "words"), [(90, 3), (75, 2), (100, 3)])
def test_join(spark, percent, words):
    rows = edited(7)
    rows += [(None, rows[0][1]), (2001, None), (2002, ""), (2003, "A b"), (2004, "a\tB"), (2005, LONG), (2006, LONG + " end"), (2004, "a b")]
    rows += [(2007, rows[5][1]), (2007, "quite another text of eleven words to be seen here once")]
    full = [(*row, "en", "s", True, 1, 1, 1, "", 1) for row in rows]
    got = jaccard_join.similar_documents(spark.createDataFrame(full, SCHEMA).repartition(4), percent, words)
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got.collect())
    assert found == plain_components(rows, percent, words)


def test_join_in_small_blocks(spark, monkeypatch):
    """A cluster whose members link to some others only, cut into blocks of a few members."""
    for name, value in (("_SKETCHES", 7), ("_SETS", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(9)
    words = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(90):
        own = list(words)
        for k in rng.sample(range(0, 150, 3), rng.choice([1, 2, 3, 4])):
            own[k] = f"n{rng.randrange(3)}"
        rows.append((i + 1, " ".join(own)))
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows, 90, 3)
    assert jaccard_join.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (10, 60, 900):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.append(a[n // 10 :], rng.integers(0, 2**63, n // 12).astype(np.uint64))
        short = jaccard_join.parities(np.append(a, b), np.repeat([0, 1], [len(a), len(b)]), 2, 32)
        assert np.bitwise_count(short[0] ^ short[1]).sum() <= n // 10 + n // 12
    