"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.llm import bpe, chat, common, packing, pii, rules, secrets, sharding, simhash, toxicity, vectors
from prismark.llm.components import components

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "the cat sat on the mat " * 40), (6, "the cat sat on the mat " * 40), (6, "the cat sat on the mat " * 40), (None, "no id here at all"), (8, "ñandú 漢字 😀 é x"), (9, "word " * 30000), (10, "a\x1cb c\xa0d\x85e"), (11, "x#y *z* $%&|<>\nx#y *z* $%&|<>\nx#y *z* $%&|<>")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return ODD + real


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 1 ---------------------------------------------------------------------------------------------------------------


def plain_measures(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs):
    got = rules.ledger(frame(spark, docs).withColumn("n_words", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *plain_measures(t)) for i, t in docs)
    for r in got:
        assert bool(r.failure_bits & 1) == (r.n_words < 10)
        assert bool(r.failure_bits & 2) == (100 * r.n_repeat_words > 20 * r.n_words)


def test_ablations(spark, docs):
    led = rules.ledger(frame(spark, docs))
    bits = [r.failure_bits for r in led.collect()]
    for r in rules.ablations(rules.patterns(led)).collect():
        p = next(p for p in rules.POLICIES if p.version == r.policy)
        one = 1 << rules.RULES[r.rule][0]
        assert r.rejected == sum(b & p.mask != 0 for b in bits) and r.failed == sum(b & one != 0 for b in bits)
        assert r.only_this == sum(b & p.mask == one for b in bits) and r.kept_without == sum(b & p.mask & ~one == 0 for b in bits)
    empty = rules.ablations(rules.patterns(rules.ledger(frame(spark, [])))).collect()
    assert empty and all(r.rejected == r.failed == r.kept_without == 0 for r in empty)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def plain_vectors(rows, cosine=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, dtype=float) / np.abs(v).max()
            good[i] = scaled / np.linalg.norm(scaled)
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine} for i in good}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen) if i is not None else None)
    return out


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows, vec = [], []
    for c in range(6):
        center = rng.normal(size=16)
        vec += [(center + rng.normal(scale=s, size=16)).tolist() for s in rng.choice([0.0, 0.05, 0.15, 0.4], 25)]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vec)), vec)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] * 8), (904, [float("nan")] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, rows[0][1]), (907, [x * 1e-300 for x in rows[0][1]]), (908, [1.0, 2.0]), rows[3], (None, rows[0][1])]
    df = frame(spark, rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = vectors.near_duplicates(df, miss=1e-6, block=16)
    want = plain_vectors(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == Counter((i, *want[i]) for i, _ in rows)
    assert vectors.near_duplicates(frame(spark, [], "vec_id long, embedding array<float>")).count() == 0


def test_vector_recall():
    rng = np.random.default_rng(1)
    k, tables = vectors.plan(50_000, 0.95, 256, 1e-3, 2.0)
    hasher = vectors.Hasher(k, tables, 2.0, 7)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(axis=1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * n / np.linalg.norm(n, axis=1)[:, None]
    assert (hasher.keys(a) == hasher.keys(b)).any(axis=1).mean() > 0.995


# --- 3 ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    low = {}
    for a, i in enumerate(ids):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return [low.get(find(a)) for a in range(len(ids))]


def test_simhash(spark, docs):
    near = [(500 + i, docs[-1][1] + " tail" * (i % 3)) for i in range(9)]
    rows = [r for r in docs + near if r[0] is not None]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    df = frame(spark, rows).withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit("x"))
    got = simhash.near_duplicates(df).select("doc_id", simhash.hexed(F.col("fingerprint")), "component_id").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want))
    assert F and simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n,m,radius", [(5, 7, 3), (70, 130, 3), (64, 64, 3), (40, 40, 5), (30, 30, 0), (20, 65, 1)])
def test_bit_planes(n, m, radius):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, m, dtype=np.uint64)
    for k in range(min(n, m)):
        x = int(a[k])
        for bit in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(bit)
        b[k] = x
    assert (simhash.within(a, b, radius) == [[bin(int(x) ^ int(y)).count("1") <= radius for y in b] for x in a]).all()


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**11])
def test_block_keys_miss_nothing(n):
    rng = random.Random(n)
    tables = simhash.block_keys(n, 3, 512)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        assert any(all((x >> s) % (1 << w) == (y >> s) % (1 << w) for s, w in t) for t in tables)


def test_fingerprints_in_hot_keys(spark):
    """Fingerprints that share all block keys but few links: more than a block of them."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = set()
    while len(values) < 300:
        x = base
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        values.add(x)
    rows = list(enumerate(values))
    want = plain_components([i for i, _ in rows], lambda a, b: bin(rows[a][1] ^ rows[b][1]).count("1") <= 3)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    got = simhash.classes(frame(spark, signed, "doc_id long, fingerprint long"), rows_in_key=8, block=32)
    assert {(r.fingerprint, r.component_id) for r in got.collect()} == {(f, c) for (_, f), c in zip(signed, want)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2001 + i) for i in range(80)] + [(7, 7), (None, 3)]
    nodes = sorted({x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e})
    at = {x: i for i, x in enumerate(nodes)}
    pairs = {frozenset((at[a], at[b])) for a, b in edges if a is not None and a != b}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    got = components(frame(spark, edges, "u long, v long"))
    assert {(r.node, r.component) for r in got.collect()} == set(zip(nodes, want))
    assert components(frame(spark, [], "u long, v long")).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------


def plain_shards(sizes, shards):
    total, start, out = sum(sizes), 0, []
    for s in sizes:
        out.append(min(shards - 1, (2 * start + s) * shards // max(1, 2 * total)))
        start += s
    return out


def test_shards(spark, docs):
    rows = [(i, t) for i, t in docs] + [(7, "hot key " * (k % 5)) for k in range(300)]
    df = frame(spark, rows).withColumn("shard", F.lit("x"))
    df = df.withColumn("size", sharding.text_size(F.col("text")))
    got = sharding.assign_shards(df, ["doc_id", "size"], "size", 24).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ordered = sorted(((r.doc_id, r.size, r.shard, r.slot) for r in got), key=lambda r: (r[2], r[3]))
    sizes = [(i, len((t or "").encode()) + 8) for i, t in rows]
    assert [r[:2] for r in ordered] == sorted(sizes, key=key)
    assert [r[2] for r in ordered] == plain_shards([r[1] for r in ordered], 24)
    by = defaultdict(list)
    for r in ordered:
        by[r[2]].append(r[3])
    assert all(v == list(range(len(v))) for v in by.values())
    assert sharding.assign_shards(df.limit(0), ["doc_id"], "size", 24).count() == 0


def test_shards_query(spark, sf):
    rows = sharding.op4_byte_balanced_shards(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in rows)
    total, top = Counter(), max(r.size for r in rows)
    for r in rows:
        total[r.shard] += r.size
    assert max(total.values()) - sum(total.values()) / 24 <= top


# --- 5 ---------------------------------------------------------------------------------------------------------------


def edits(a, b):
    """Characters more, less or other, and neighbours swapped; none is edited twice."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] != a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_match(word, terms):
    found = []
    for t in terms:
        most, bare = toxicity.allowed(t), t.rstrip("*")
        if t.endswith("*"):
            k = min(edits(word[:n], bare) for n in range(min(len(word), len(bare) + most) + 1))
        else:
            k = edits(word, t) if abs(len(word) - len(t)) <= most else 99
        if k <= most:
            found.append((k, t.endswith("*"), t))
    best = min(found, default=None)
    return best and (best[2], best[0])


def test_automaton():
    rng = random.Random(1)
    terms = ["idiot", "moron", "trash", "scum", "worthless", "worthlessly", "loses", "loser", "abc", "vequ*", "idio*", "moronic*", "disgus*", "disgusting"]
    m = toxicity.Matcher(terms)
    words = ["", *terms]
    for t in terms:
        for k in range(150):
            w = list(t.rstrip("*") + rng.choice(["", "", "s", "ting"]))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(w))
                if rng.random() < 0.4 and 0 < at < len(w):
                    w[at - 1], w[at] = w[at], w[at - 1]
                else:
                    w[at : at + rng.randint(0, 1)] = [rng.choice("abcdiot")] * rng.randint(0, 1)
            words.append("".join(w))
    for w in words:
        assert m.match(w) == plain_match(w, terms), w
    m.MOST = 5  # forgets all states each time
    assert all(m.match(w) == plain_match(w, terms) for w in words[:200])


def plain_score(lex, text, ever=None):
    """From the definitions: every word (of those that match at all) against every term, the strongest context of each kind of match, then the log odds."""
    words, far = text.lower().split(), {}
    for at, w in enumerate(words):
        bare = w.strip(toxicity.EDGE)
        hit = plain_match(bare, lex.terms) if ever is None or w in ever else None
        if hit:
            begins = bare[: 4 if len(hit[0].rstrip("*")) < 8 else 6] == hit[0].rstrip("*")[: 4 if len(hit[0].rstrip("*")) < 8 else 6]
            key = hit[0], [0, 1 if begins else 2, 3][hit[1]]
            far[key] = max(far.get(key, 0), toxicity.quoted(words, at))
    most = max(far.values(), default=0)
    odds = (1 - most) * lex.bias + most * lex.prior + sum(lex.weights[k] * f for k, f in far.items())
    return 1 / (1 + np.exp(-max(-40, min(40, odds))))


def test_toxicity_scores(spark, sf):
    """A lexicon does not depend on the order of rows, and scores are those of the definitions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.repartition(7, "text").orderBy(F.desc("doc_id")), labels.repartition(3))
    assert (lex.terms, lex.weights, lex.bias, lex.prior) == (again.terms, again.weights, again.bias, again.prior) and lex.terms
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:40]
    texts = [t[:1500] for t in texts] + [f"so {w} is" for t in lex.terms[:8] for w in (t, t[1] + t[0] + t[2:], t + "s", '"' + t + '"')]
    s = toxicity.Scorer(lex)
    for t in texts:
        assert s.score(t) == pytest.approx(plain_score(lex, t), abs=1e-12)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op5_levenshtein_lexicon(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    # 7 of the 97 held-out toxic labels here stand on texts without any abusive word
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioutrnslm") for _ in range(rng.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w = prose(40)
        if i % 6 == 0:
            w[rng.randrange(40)] = "gribblefax"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    lex = toxicity.learn(frame(spark, rows), frame(spark, labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert "gribblefax" in lex.terms
    s = toxicity.Scorer(lex)
    base = " ".join(prose(20))
    assert s.score(base) < 0.5 < s.score(base + " gribblefax") and s.score(base + " you gribblefux now") > 0.5
    assert s.score(base + ' he said "gribblefax" then') < s.score(base + " gribblefax then")
    assert 0 <= s.score("") < 0.5
    got = toxicity.score(frame(spark, ODD).withColumn("score", F.lit("x")), lex).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.learn(frame(spark, rows), frame(spark, [], "doc_id long, toxic int"))
    assert none.terms == [] and toxicity.Scorer(none).score("x") < 0.5
    assert toxicity.score(frame(spark, []), lex).count() == 0


def test_toxicity_misspelled_inflections(spark):
    """A term learned as a stem too is met with an edit in any place, its first letters included."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeurnslm") for _ in range(rng.randint(2, 8)))
    abuse = ["idiot"] * 200 + ["idiots"] * 40 + ["idiotic"] * 15
    rows = [(i, " ".join([*(word() for _ in range(20)), *([abuse[i]] if i < len(abuse) else []), *(word() for _ in range(20))])) for i in range(1200)]
    lex = toxicity.learn(frame(spark, rows), frame(spark, [(i, int(i < len(abuse))) for i, _ in rows], "doc_id long, toxic int"))
    assert "idiot" in lex.terms and any(t.startswith("idio") and t.endswith("*") for t in lex.terms)
    s = toxicity.Scorer(lex)
    base = " ".join(word() for _ in range(20))
    assert s.score(base) < 0.5
    for w in ("idiot", "idiots", "idiotic", "ldiot", "1diot", "idi0t", "iidiot", "diiot", "didiots", "idiotically"):
        assert s.score(f"{base} you {w} now") > 0.5, w


def test_quoted():
    far = lambda text: toxicity.quoted(text.split(), [w.strip(toxicity.EDGE) for w in text.split()].index("idiot"))
    for text in ('"Hello" you idiot "bye"', "« Salut » you idiot « adieu »", 'and "so then", you idiot "bye"', 'you idiot "bye"', "you idiot « adieu »", '"Hello" you idiot', 'she had "one idea", idiot, not "two"'):
        assert far(text) == 1.0, text
    for text in ('the note: "you idiot" was it', "« you idiot » was it", '"Hello" and "you idiot" and "bye"', '"idiot", it read', '« idiot »', '("you idiot")', "she said idiot", '„du idiot“ hat es', '“you idiot” it read', '»du idiot« war es', '"Hello you «idiot»'):
        assert far(text) == 0.3, text


# --- 6 ---------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans(spark, docs):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", "1", "23", "255", "256", ".", "-", " ", "+", "+1", "(", "_", "é", "😀", "\n", "0004", "4944339490429605", "a@b.c", "1.2.3.4", "%"]
    rows = docs + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1000, 1600)]
    rows += [(2000, "x@y.z " * 600 + "1.2.3.4 " * 300), (2001, "a" * 2000 + "@"), (2002, "1" * 5000), (2003, "a@b" + ".c" * 2000)]
    got = pii.with_base_spans(frame(spark, rows)).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base_spans)) for r in got) == Counter((i, tuple(plain_pii(t or ""))) for i, t in rows)


def plain_disclosure(rows, rule=pii.Disclosure()):
    """All words of one-entity texts, by counting."""
    term = lambda w: re.sub(r"^[^\w]+|[^\w]+$", "", w).lower()
    df, co, ctx, held, ents = Counter(), Counter(), defaultdict(set), Counter(), {}
    for i, t in rows:
        df.update({term(m) for m in WORD.findall(t)})
        spans = plain_pii(t)
        words = [(m.start(), m.end(), term(m[0])) for m in WORD.finditer(t)]
        inside = {k for k, (a, b, _) in enumerate(words) for s in spans if a < s[2] and b > s[1]}
        ents[i] = {t[s[1] : s[2]].lower() for s in spans}
        held.update(ents[i])
        found = set()
        for s in spans:
            mine = [k for k, (a, b, _) in enumerate(words) if a < s[2] and b > s[1]]
            near = {words[k][2] for k in [*range(mine[0] - rule.window, mine[0]), *range(mine[-1] + 1, mine[-1] + 1 + rule.window)] if 0 <= k < len(words) and k not in inside and len(words[k][2]) >= rule.min_chars}
            for w in near:
                found.add((t[s[1] : s[2]].lower(), w))
                ctx[t[s[1] : s[2]].lower(), w].add(frozenset(near))
        co.update(found)
    told = {k: 1 + np.log2(co[k] / df[k[1]]) / np.log2(len(rows) / held[k[0]]) for k in co if len(ctx[k]) >= rule.min_contexts}
    out = {}
    for i, t in rows:
        words = [(m.start(), m.end(), term(m[0])) for m in WORD.finditer(t)]
        spans = plain_pii(t)
        out[i] = [(a, b) for a, b, w in words if not any(a < s[2] and b > s[1] for s in spans) and max((told.get((e, w), -9) for e in ents[i]), default=-9) >= rule.generalise]
    return out


def test_disclosure(spark):
    rows = [(1, "mail bob@x.org is Johnny Zed, of Quux"), (2, "so Johnny Zed wrote bob@x.org yesterday again"), (3, "Johnny Zed (bob@x.org) said hi"), (4, "the mail is of a cat"), (5, "ann@y.org wrote of cats and mail"), (6, "of mail and cats ann@y.org said")]
    rows += [(7, rows[0][1])] + [(i, f"the mail is of {i} cats and so on, yesterday again said wrote") for i in range(10, 60)]
    got = pii.find(frame(spark, rows).withColumn("extra", F.lit(1))).collect()
    want = plain_disclosure(rows)
    assert {r.doc_id: [(s.start, s.end) for s in r.extra] for r in got} == want and want[1]
    clean = {r.doc_id: r.text for r in pii.redact(pii.find(frame(spark, rows))).collect()}
    assert "bob@x.org" not in clean[1] and "Johnny" not in clean[1] and clean[4] == "the mail is of a cat"
    assert pii.find(frame(spark, [])).count() == 0
    odd = pii.redact(pii.find(frame(spark, ODD))).collect()
    assert Counter((r.doc_id, r.text) for r in odd) == Counter(ODD)


def test_disclosure_at_length(spark):
    """Longer texts with several entities of all kinds, which touch and overlap; few terms and many are counted alike."""
    rng = random.Random(11)
    names = ["Quux", "Zed", "Bor-is", "ÉLAN", "x9", "...", "Ann,", "(Ty)", "😀"]
    parts = [*names, *(f"word{k}" for k in range(40)), "bob@x.org", "(ann@y.org),", "bob@x.org/ann@y.org", "+1 555 010 9999", "4944 3394 9042 9605", "10.0.0.1", "+4944339490429605", "10.0.0.1;10.0.0.2"]
    rows = []
    for i in range(60):
        w = [rng.choice(parts) for _ in range(rng.randint(5, 150))]
        for k in [k for k, x in enumerate(w) if x == "bob@x.org"]:
            w[k : k + 1] = ["bob@x.org", "Quux"] if rng.random() < 0.5 else ["Zed", "bob@x.org"]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    rows += [(100 + i, " ".join(f"word{rng.randrange(40)}" for _ in range(50))) for i in range(80)]
    loose = pii.Disclosure(window=3, generalise=0.3, remove=0.6)
    want = plain_disclosure(rows, loose)
    for few in (10_000, 0):
        got = pii.find(frame(spark, rows), rule=loose, few=few).collect()
        assert {r.doc_id: [(s.start, s.end) for s in r.extra] for r in got} == want
    assert sum(map(len, want.values())) > 20


def test_terms_in(spark):
    rng = random.Random(1)
    parts = ["a", "B.c", "--", "#", "\n", " ", "\t", "é", "ΑΣ", "'", "😀", "1,2", ".", "漢"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(-1, "#" * 50000 + "x"), (-2, ""), (-3, " -- "), (-4, None)]
    got = frame(spark, rows).select("doc_id", pii.terms_in(F.col("text")).alias("t")).collect()
    term = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
    want = dict(rows)
    for r in got:
        assert set(r.t) - {""} == {term(w) for w in WORD.findall(want[r.doc_id] or "")} - {""} and len(set(r.t)) == len(r.t)


def test_very_many_entities_in_one_text(spark):
    text = " ".join(f"w{k} u{k}@x.org Bob{k % 7}" for k in range(50_000))
    got = pii.find(frame(spark, [(1, text), (2, "hello u1@x.org Bob1 there"), (3, "nothing")])).collect()
    spans = {r.doc_id: [(s.start, s.end) for s in r.base_spans] for r in got}
    assert len(spans[1]) == 50_000 and spans[2] == [(6, 14)] and all(text[a:b].endswith("@x.org") for a, b in spans[1][::999])


def test_generalised_by_kind(spark):
    words = {"4711": "[NUMBER]", "Quux": "[NAME]", "(élan)": "[WORD]", "a4": "[CODE]", "“Zed”": "[NAME]"}
    got = frame(spark, list(enumerate(words))).select("text", pii.kind_of(F.col("text")).alias("k")).collect()
    assert dict(map(tuple, got)) == words


# --- 7 ---------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, docs):
    rng = random.Random(9)
    parts = ["password", "Secret", "api_key", "APIKEY", "toKen", "=", ":", " ", '"', "abcd1234", "AKIA", "ABCDEF012345", "0123456789abcdef" * 2, "é", "😀", "\n", "ſecret", "pwd: ", "x"]
    rows = docs + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for i in range(1000, 2000)] + [(3000, "token=" + "a1" * 30000)]
    got = secrets.secrets(frame(spark, rows).withColumn("kinds", F.lit(1))).collect()
    base = lambda r: tuple(x for x in zip(r.kinds, r.starts, r.ends) if x[0] != "guess")
    assert Counter((r.doc_id, base(r)) for r in got) == Counter((i, tuple(plain_secrets(t or ""))) for i, t in rows)
    assert secrets.secrets(frame(spark, [])).count() == 0


DICTIONARY = ["password", "correct", "horse", "monkey", "admin", "aaa", "abc", "key", "lee", "rty"]


def plain_cost(v, words):
    """The least cost of a string as one segment, by the definitions; None if it can't be one."""
    low = v.lower()
    out = []
    size = lambda c: 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    if len(v) == 1:
        out.append(np.log10(size(v)) + (np.log10(2) if v.isupper() else 0))
    near = lambda a, b: b in secrets.NEAR.get(a, ())
    if len(v) >= 3 and len(set(low)) == 1:
        out.append(np.log10(2 * size(low[0]) * len(v)))
    if len(v) >= 4 and all(near(a, b) for a, b in zip(low, low[1:])):
        ways = [tuple(np.subtract(secrets.PLACE[b], secrets.PLACE[a])) for a, b in zip(low, low[1:])]
        out.append(np.log10(2 * 36 * len(v)) + sum(x != y for x, y in zip(ways, ways[1:])) * np.log10(4))
    if len(v) >= 3 and low.isalnum() and {ord(b) - ord(a) for a, b in zip(low, low[1:])} in ({1}, {-1}):
        out.append(np.log10(2 * 2 * size(low[-1]) * len(v)))
    for form, many in (("Y", 200), ("YsM", 2400), ("YsMsD", 73000), ("DsMsY", 73000)):
        pattern = form.replace("s", "[-/.]?").replace("Y", "(19|20)[0-9][0-9]").replace("M", "(0[1-9]|1[0-2])").replace("D", "(0[1-9]|[12][0-9]|3[01])")
        if re.fullmatch(pattern, low):
            out.append(np.log10(2 * many))
    plain = "".join({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in low)
    for spelt, extra in ((low, 0), (plain, np.log10(4))):
        if spelt in words and not (extra and plain == low):
            case = 0 if v == low else np.log10(2) * (1 if v.isupper() or v[0].isupper() and v[1:] == low[1:] else min(len(v), 8))
            out.append(np.log10(2 * (words.index(spelt) + 1)) + extra + case)
    return min(out, default=None)


def plain_guesses(v, words):
    """Over all ways to cut v."""
    best = [0.0]
    for i in range(1, len(v) + 1):
        best.append(min(best[j] + c for j in range(i) if (c := plain_cost(v[j:i], words)) is not None))
    return best[-1]


def test_guess_costs_are_least():
    rng = random.Random(7)
    words = secrets.ranked(DICTIONARY)
    parts = ["a", "aa", "A", "b", "c", "abc", "cba", "qwe", "rty", "uio", "1", "12", "321", "2019", "-03", "/", "04", "31", "monke", "y", "yyy", "P@ssw0rd", "h0rs3", "hor", "se", "K", "ey", "é", "éé", "İ", "_", "19", "99", "poi", "asdf"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(1500)]
    values += ["".join(rng.choice("ab1y9Q") for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["y" * 40, "qwertyuioppoiuytrewq" * 2, "abcdefgfedcbabcd", "aaabbbccc" * 4, "abcabcabc", "19991231"]
    for v in values:
        total, cuts = secrets.segments(v, words)
        assert total == pytest.approx(plain_guesses(v, DICTIONARY), abs=1e-9), (v, cuts)
        assert "".join(v[a:b] for a, b, _ in cuts) == v
    for v in ("aab12", "qw9Y", "3aaA", "ab1cb"):  # and over each way to cut, one by one
        ways = []
        for mask in range(1 << (len(v) - 1)):
            ends = [0, *(i + 1 for i in range(len(v) - 1) if mask >> i & 1), len(v)]
            each = [plain_cost(v[a:b], DICTIONARY) for a, b in zip(ends, ends[1:])]
            ways += [] if None in each else [sum(each)]
        assert min(ways) == pytest.approx(secrets.segments(v, words)[0])


def test_guess_costs():
    words = secrets.ranked(["password", *(f"w{k}w" for k in range(499)), "correct", "horse"])
    cost = lambda v: secrets.segments(v, words)[0]
    assert cost("password") < cost("Password") < cost("passw0rd1") < cost("b7db7aa4a5fcc783")
    assert cost("aaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("abcdefgh") < 5 and cost("20190304") < 6 and cost("") == 0
    spans, _ = secrets.scan("pwd is G7#kd0!zzQ and password: password", words, 8.0)
    assert ("guess", 7, 17) in spans and len([s for s in spans if s[0] == "guess"]) == 1
    assert secrets.segments("x", secrets.ranked([]))[0] > 1


def test_whole_vocabulary():
    import public_tokenizers

    words = secrets.ranks(public_tokenizers.path("word_bpe_49k.json"))
    for w in ("contamination", "philharmonic", "monkeyyyyyyyyy", "dragonnnnnnnn", "adminnnnnnnnn"):
        assert not [s for s in secrets.scan(f"the secret is {w}", words, 8.0)[0] if s[0] == "guess"]
    assert "contamination" in words.rank and max(map(len, words.rank)) > 16


# --- 8 ---------------------------------------------------------------------------------------------------------------

VOCAB8 = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_tokenizer(docs):
    tok = packing.WordTokenizer(VOCAB8)
    rng = random.Random(1)
    letters = "abCDİΣsßÉé́ͅ \n\tſK\x1c\x85\xa0漢字😀123!?$''<|endoftext|>²½"
    texts = [t or "" for _, t in docs] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a <|endoftext|>b"]
    for t, e in zip(texts, tok.lib.encode_batch(texts, add_special_tokens=False)):
        assert tok.encode(t.encode()) == struct.pack(f"<{len(e.ids)}I", *e.ids)


def test_word_tokenizer_tables(docs):
    """Tables that turn over in the middle of texts, and words that are too long to keep."""
    tok = packing.WordTokenizer(VOCAB8, most=40)
    texts = [t for _, t in docs if t] + ["word " + "x" * 500 + " " + "ä" * 70 + " word, " + "é漢 z" * 30] * 2
    for t in texts + texts[::-1]:
        ids = tok.lib.encode(t, add_special_tokens=False).ids
        assert tok.encode(t.encode()) == struct.pack(f"<{len(ids)}I", *ids)
        assert len(tok.known) <= 40 and len(tok.words) <= 40 and len(tok.known_before) <= 80 and len(tok.words_before) <= 80
        assert all(len(w) <= 64 for w in [*tok.known, *tok.words])


def check_pieces(rows, texts, limits, exact):
    tok = packing.WordTokenizer(VOCAB8)
    ids = {i: tok.encode((t or "").encode()) + struct.pack("<I", 2) for i, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    if exact:
        assert by_doc.keys() == ids.keys()
        for i, parts in by_doc.items():
            assert b"".join(p for _, p, _ in sorted(parts)) == ids[i] and {n for *_, n in parts} == {len(ids[i]) // 4}
    padding = used = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= limits.tokens and len(parts) <= limits.segments
        used += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / used


def test_packing(spark, docs):
    rows = [r for r in dict(docs).items() if r[0] is not None]
    df = frame(spark, rows).withColumn("start", F.lit("x")).coalesce(1)
    limits = packing.Limits()
    assert check_pieces(packing.pack(df, VOCAB8).collect(), rows, limits, True) < 0.1
    small = packing.Limits(64, 5, 64)
    check_pieces(packing.pack(df, VOCAB8, limits=small, pool_items=50).collect(), rows, small, True)
    assert packing.pack(frame(spark, []), VOCAB8).count() == 0
    repeated = packing.pack(frame(spark, [(None, "a b"), (1, None), (1, None)]).coalesce(1), VOCAB8).collect()
    whole = Counter()
    for r in repeated:
        whole[r.doc_id] += r.length
    assert whole == {None: 3, 1: 2}


def plain_pack(docs, limits):
    """One pool, by the definition: largest dot product of what fits whole, else the most of any item; short rows in powers of two."""
    prompts = {i: f for i, _, f in docs}
    left = [[i, n, min(f, n), 0] for i, n, f in docs]  # key, tokens left, of them without loss, tokens placed
    out = []
    while any(x[1] for x in left):
        room, row = [limits.tokens, limits.segments, limits.loss], []
        while room[0] >= 1 and room[1] >= 1 and any(x[1] for x in left):
            best, pick = -1.0, None
            for x in left:
                need = x[1], 1, max(0, x[1] - x[2])
                if x[1] and all(a <= b for a, b in zip(need, room)):
                    dot = sum(a / c * (b / c) for a, b, c in zip(need, room, (limits.tokens, limits.segments, limits.loss)))
                    if dot > best + 1e-15:
                        best, pick = dot, (x, x[1])
            if pick is None:
                most = (0, -1)
                for x in left:
                    n = min(x[1], room[0], x[2] + room[2])
                    if n and (n, max(0, n - x[2])) > most:
                        most, pick = (n, max(0, n - x[2])), (x, n)
            if pick is None:
                break
            x, n = pick
            row.append((x[0], x[3], n))
            room = [room[0] - n, room[1] - 1, room[2] - max(0, n - x[2])]
            x[1], x[2], x[3] = x[1] - n, max(0, x[2] - n), x[3] + n
        total = sum(n for *_, n in row)
        if 64 <= total < limits.tokens:
            for _ in range(total % 64):  # token by token
                key, start, n = row.pop()
                x = next(x for x in left if x[0] == key)
                x[1], x[3] = x[1] + 1, x[3] - 1
                x[2] = max(0, prompts[key] - x[3])
                if n > 1:
                    row.append((key, start, n - 1))
        out.append(row)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(64, 5, 40), packing.Limits(256, 4, 128), packing.Limits(197, 9, 130)])
def test_packing_like_plain_dot_products(limits):
    rng = random.Random(limits.tokens)
    docs = [(i, n, min(n, f)) for i in range(150) for n, f in [(rng.choice([1, 2, 7, 30, 60, 200, rng.randint(1, 90)]), rng.choice([0, 0, 3, 20]))]]
    items = [packing.Item(*d) for d in docs]
    got = [[(x.key, a, n) for x, a, n in row] for row in packing.pack_items(items, limits, True)]
    assert got == plain_pack(docs, limits) and not items


def test_packing_keeps_limits(spark, docs):
    """The query's rule: the first quarter of a text bears no loss. (A sequence that a limit ends is cut to a multiple of 64 and goes out in powers of two; that the segment limit binds is held above.)"""
    rows = [r for r in dict(docs).items() if r[0] is not None] + [(10_000 + i, "a b") for i in range(600)] + [(20_000 + i, "x y z w " * 300) for i in range(40)] + [(30_000 + i, "q w e r " * 20_000) for i in range(3)]
    tok = packing.WordTokenizer(VOCAB8)
    free = {i: int(packing.QUERY_PROMPT * (len(tok.encode((t or "").encode())) // 4)) for i, t in rows}
    limits = packing.QUERY_LIMITS
    got = packing.pack(frame(spark, rows).coalesce(1), VOCAB8, limits=limits, prompt=packing.QUERY_PROMPT).collect()
    assert check_pieces(got, rows, limits, True) == 0
    loss, parts, size = Counter(), Counter(), Counter()
    for r in got:
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, free[r.doc_id]))
        parts[r.sequence_id] += 1
        size[r.sequence_id] += r.length
    assert max(loss.values()) <= limits.loss and max(parts.values()) <= limits.segments and max(size.values()) == limits.tokens
    items = [packing.Item(i, len(tok.encode((t or '').encode())) // 4 + 1, free[i]) for i, t in rows]
    made = [(sum(n for *_, n in row), sum(max(0, a + n - max(a, x.free)) for x, a, n in row)) for row in packing.pack_items(items, limits, True)]
    assert any(n < limits.tokens and b == limits.loss for n, b in made)  # the loss limit ends a sequence


def test_words_of_any_length(spark):
    """A word of 20 MB fills no table, and batches are cut by bytes."""
    word = "ab9" * 7_000_000
    tok = packing.WordTokenizer(VOCAB8)
    tok.encode(word[:300_000].encode())
    enc = bpe.PrefixEncoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    enc.encode("x " + word[:300_000])
    for met in (tok.known, tok.words, enc.known, enc.spans):
        assert all(len(k) <= common.LONGEST for k in met)
    found = toxicity.Scorer(toxicity.Lexicon(["worthless"], {("worthless", k): 9.0 for k in toxicity.KINDS}, -3.0, -1.0))
    assert found.score(word) < 0.5 and not found.none
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": ["x" * (1 << 18)] * 48 + ["y" * (9 << 20), None]})
    cuts = list(common.pieces(batch, [1]))
    assert [x for c in cuts for x in c.column(0).to_pylist()] == list(range(50)) and max(c.num_rows for c in cuts[:-1]) == 16
    rows = [(1, word), (2, "a b"), (3, word + " idiot")]
    assert {r.doc_id: r.n_words for r in rules.ledger(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2}


def test_packing_loss_limit(spark):
    rows = [(i, "word " * (10 + i % 50), 5) for i in range(300)]
    df = frame(spark, rows, "doc_id long, text string, prompt long").coalesce(1)
    limits = packing.Limits(128, 8, 60)
    got = packing.pack(df, VOCAB8, limits=limits, loss_from="prompt").collect()
    loss = defaultdict(int)
    for r in got:
        loss[r.sequence_id] += max(0, r.start + r.length - max(r.start, 5))
    assert max(loss.values()) <= 60
    check_pieces(got, [r[:2] for r in rows], limits, False)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_prefix_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, enc = Tokenizer.from_file(path), bpe.PrefixEncoder(path)
    rng = random.Random(1)
    letters = "abcdefghij  \n\t'sré漢字😀́\xa0​\x1c0123!?$<|endoftext|>"
    texts = [t or "" for _, t in docs]
    for i in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        texts.append(s + "<|endoftext|>" + s if i % 5 == 0 else s)
    texts += ["".join(rng.choice(["the", "in", "g", "tion", "er", "a", " ", "re", "ing", "  "]) for _ in range(60)) for _ in range(300)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = enc.encode(t)
        assert ids == struct.pack(f"<{len(e.ids)}I", *e.ids)
        assert enc.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)
    got = bpe.encode_and_decode(frame(spark, docs).withColumn("ids", F.lit(1)), path).collect()
    assert all(r.decoded == (r.text or "") and len(r.ids) == 4 * r.n_tokens for r in got) and len(got) == len(docs)
    assert bpe.encode_and_decode(frame(spark, []), path).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_chat(turns):
    loss = "".join(x for r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)


def test_chat_round_trip(spark):
    rng = random.Random(8)
    parts = [*chat.CONTROL, "\\", "<", "[", "\n", "a", "é😀", "<\\s>", "[\\\\INST]", "|im_end|>", "<\\|im_start|>", " "]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "to\nol\\n", None, ""]), text))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(130)] + [(101, None, "user", "x"), (None, 0, "user", "y"), (102, 1, "user", "same"), (102, 1, "user", "same")]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        want[str(c) if c is not None else ""] = plain_chat([(r, x) for _, _, r, x in turns])
    made = chat.conversations(frame(spark, rows, TURNS).withColumn("tree", F.lit(1)).withColumn("score", F.lit("x")))
    got = {r.tree: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made, ["tree"]).collect()}
    assert got == want
    for r in made.collect():  # no control string of a text is alive
        inside = r.formatted
        assert inside.count(chat.START) == inside.count(chat.END) == r.n_turns and "</s>" not in inside and "[INST]" not in inside
    assert chat.conversations(frame(spark, [], TURNS)).count() == 0


def test_reply_trees(spark):
    rng = random.Random(6)
    rows = []
    for tree in range(12):
        for node in range(rng.randint(1, 30)):
            rows.append((tree, node, rng.choice([None, 999]) if node == 0 else rng.randrange(max(0, node - 3), node), float(rng.randint(0, 3))))
    rows += [(50, 1, 2, 0.0), (50, 2, 1, 0.0)]  # a cycle
    want = set()
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        leaves = nodes.keys() - {r[2] for r in nodes.values()}
        paths = []
        for leaf in leaves:
            path = [leaf]
            while nodes[path[-1]][2] in nodes:
                path.append(nodes[path[-1]][2])
            paths.append((-round(sum(nodes[x][3] for x in path) / len(path), 9), -len(path), leaf, path[::-1]))
        for k, p in enumerate(sorted(paths)[:2]):
            want |= {(tree, x, k + 1, d + 1) for d, x in enumerate(p[3])}
    got = chat.chosen_paths(frame(spark, rows, "tree long, node long, parent long, score double"), top=2)
    assert {tuple(r) for r in got.select("tree", "node", "path", "depth").collect()} == want


def test_repeated_nodes_and_null_texts(spark):
    rows = [(1, 1, None, "user", "b"), (1, 1, None, "user", "a"), (1, 2, 1, None, None), (2, 5, None, "assistant", "x")]
    df = frame(spark, [(*r, 0.0) for r in rows], "tree long, node long, parent long, role string, text string, score double").withColumn("loss", F.lit(1))
    got = chat.format_paths(df, chat.chosen_paths(df)).collect()
    assert {r.tree: chat.parse(r.formatted) for r in got} == {1: [("user", "a"), ("", "")], 2: [("assistant", "x")]}
