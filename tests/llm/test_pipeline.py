"""The corpus pipeline against a plain version of each stage, and the registered queries."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry

from prismark.llm import registry

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert registry.ORACLE_SQL.keys() <= names.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "pii", "packing"]


def plain_kept(text):
    """The base and current rules, from their definitions and plain measurements."""
    import test_operators as plain

    t = text or ""
    n, chars, symbols, dups, repeated = plain.plain_measures(t)
    lines = sum(bool(plain.WORD.search(x)) for x in t.split("\n"))
    distinct = len(set(plain.WORD.findall(t)))
    poor = n < 10 or 100 * repeated > 20 * n or 4 * symbols > n or chars < 2 * n or chars > 20 * n or dups >= 4 and 10 * dups > 5 * lines or n >= 100 and 20 * distinct < n
    return not poor


def plain_redacted(text, terms):
    """Entities and terms replaced from the left, the longest first."""
    import test_operators as plain

    marks = sorted([(a, -b, f"[{k.upper()}]") for k, a, b in plain.plain_pii(text)] + [(a, -b, m) for a, b, m in terms])
    out, at = "", 0
    for a, b, mark in marks:
        if a >= at:
            out, at = out + text[at:a] + mark, -b
    return out + text[at:]


def kind(word):
    figures, letters = any(c.isnumeric() for c in word), any(c.isalpha() for c in word)
    first = next((c for c in word if c.isalpha()), "")
    return "[NUMBER]" if figures and not letters else "[CODE]" if figures else "[NAME]" if first.isupper() else "[WORD]"


def test_stages(spark):
    import test_operators as plain

    from prismark.llm import packing, pii, toxicity
    from prismark.llm.common import cut, table

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf, "labels"))
    kept = {r.doc_id: r.text for r in docs.collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, sf), name)
        steps.append((name, {r.doc_id: r.text for r in made.collect()} if name != "packing" else made.collect()))
        if name != "packing":
            assert made.columns == list(corpus_pipeline.DOCUMENT) and made.count() == len(steps[-1][1])
            docs = made
    ever = {w for w in {w for t in kept.values() for w in (t or "").lower().split()} if plain.plain_match(w.strip(toxicity.EDGE), lexicon.terms)}
    kept = {i: t for i, t in kept.items() if plain.plain_score(lexicon, t or "", ever) < 0.5}
    assert steps[0][1] == kept
    kept = {i: t for i, t in kept.items() if plain_kept(t)}
    assert steps[1][1] == kept
    ids = sorted(kept)
    prints = [plain.plain_fingerprint(kept[i]) for i in ids]
    comp = plain.plain_components(ids, lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    kept = {i: kept[i] for i, c in zip(ids, comp) if i == c}
    assert steps[2][1] == kept
    rule = pii.Disclosure()
    rows = sorted((i, t or "") for i, t in kept.items())
    spans, strong = plain.plain_disclosure(rows, rule), plain.plain_disclosure(rows, pii.Disclosure(generalise=rule.remove))
    clean = steps[3][1]
    assert clean == {i: plain_redacted(t, [(a, b, "" if (a, b) in strong[i] else kind(t[a:b])) for a, b in spans[i]]) for i, t in rows}
    tok = packing.WordTokenizer(plain.VOCAB8)
    ids = {i: tok.encode((t or "").encode()) + (2).to_bytes(4, "little") for i, t in clean.items()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in steps[4][1]:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == ids.keys()
    for held, whole in [(p, len(ids[i]) // 4) for i, p in parts.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, n in sorted(held):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 4096
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect())) == Counter((i, len(x) // 4, len(x) // 4) for i, x in ids.items())


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an extra column that clashes, and no rows at all."""
    import test_operators as plain


    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, failure_bits string"
    rows = [(i, t, None if k % 2 else "en", None, None if k % 3 else len(t or ""), "x", None) for k, (i, t) in enumerate(plain.ODD)]
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, spark.createDataFrame(given, schema), str(tmp_path))
            got = made.collect()
            if name == "packing":
                assert {r.doc_id for r in got} == {r[0] for r in given}
                continue
            assert made.columns == list(corpus_pipeline.DOCUMENT)
            if name == "toxicity":
                assert {r.doc_id for r in got} <= {r[0] for r in given}
            if name == "quality":
                assert all(len((r.text or "").split()) >= 10 for r in got)
            if name == "simhash" and given:
                assert Counter(r.doc_id for r in got) == Counter([None, 1, 4, 5, 8, 9, 10, 11])
            if name == "pii":
                assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in given)


def test_distinct_texts_under_one_id_stay(spark):
    """Only copies go where rows share an id, whether one of them is a copy of a smaller id or not."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in ("red", "blue", "green"))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, a + " more"), (9, c), (9, c), (None, a)]
    rows = [(i, t, "en", "x", len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    named = Counter((r.doc_id, r.text) for r in got if r.text != a + " more")
    assert named == Counter([(3, a), (5, b), (8, c), (None, a)])


def test_rows_that_tie_stay_the_same_way(spark):
    """Texts of one id and one fingerprint: which of them stays does not hang on their order."""
    rows = [(4, t, lang, None, 9) for t in ("a b c", "A B C", "a  b c", None, "") for lang in ("en", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = [corpus_pipeline.drop_copies(spark, spark.createDataFrame(r, schema).repartition(3), SF).collect() for r in (rows, rows[::-1])]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == 2


def test_terms_that_give_entities_away(spark):
    import test_operators as plain

    from prismark.llm import pii

    rows = [(1, "mail bob@x.org is Johnny Zed, of Quux"), (2, "so Johnny Zed wrote bob@x.org yesterday again"), (3, "Johnny Zed (bob@x.org) said hi"), (4, "ann@y.org wrote of a12 and johnny"), (5, "of a12 (élan) 99 ann@y.org said élan 99"), (6, "99 or a12, élan said ann@y.org")]
    rows += [(i, f"the mail is of {i}00 cats and so on, yesterday again said wrote") for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.redact_private(spark, docs, SF).collect()}
    rule = pii.Disclosure()
    spans, strong = plain.plain_disclosure(rows, rule), plain.plain_disclosure(rows, pii.Disclosure(generalise=rule.remove))
    want = {i: plain_redacted(t, [(a, b, "" if (a, b) in strong[i] else kind(t[a:b])) for a, b in spans[i]]) for i, t in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()} and any(strong.values())
