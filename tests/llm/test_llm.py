"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import decontaminate, fingerprints, language, licenses, near_dedup, packing, substring_dedup, suffix_dedup, toxicity, warc_zip

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ko ti mu re sa lo".split() for b in "dan ster ling mo".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared, base = prose(70, 1), prose(120, 2)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (10, 60)]
    rows = [base, base, *near, prose(30, 3) + " " + shared, shared + " " + prose(25, 4), prose(10, 5) + " " + shared + " é" + prose(5, 6)]
    rows += ["", None, "ab " * 300, "word", prose(49, 7), prose(400, 8), prose(6, 8), "one two", "\n\t "]
    return list(enumerate(rows))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], FIELDS)
    if extra:  # names that the operators use inside
        for c in ("k1", "k2", "cls", "ctx", "score", "n", "lo", "band", "item_id", "part", "ids", "own"):
            df = df.selectExpr("*", f"1 AS `{c}`")
    return df


def windows_removed(rows, items_of, length, counts):
    found = {}
    for d, t in rows:
        x = items_of(t)
        for i in range(len(x) - length + 1):
            found.setdefault(tuple(x[i : i + length]), []).append(d)
    for d, t in rows:
        x = items_of(t)
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if counts(found[tuple(x[i : i + length])], d):
                gone[i : i + length] = [True] * length
        yield d, x, gone


@pytest.mark.parametrize("extra", [False, True])
def test_suffix_dedup_matches_brute_force(spark, texts, extra):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(frame(spark, texts, extra)).collect()}
    assert len(got) == len(texts)
    for d, x, gone in windows_removed(texts, lambda t: (t or "").encode(), 200, lambda ds, d: len(ds) > 1):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert got[d] == (len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())


@pytest.mark.parametrize("extra", [False, True])
def test_substring_dedup_matches_brute_force(spark, texts, extra):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, texts, extra)).collect()}
    items = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for d, x, gone in windows_removed(texts, items, 50, lambda ds, d: min(ds) < d):
        assert got[d] == (len(x), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(x, gone) if not g).encode()).hexdigest())


def test_suffix_order_sorts_the_suffixes():
    r = np.random.default_rng(0)
    row = np.repeat(np.arange(5), [4, 1, 6, 3, 6])
    symbol = r.integers(0, 3, len(row)).astype(np.uint64)
    keys = [tuple(symbol[i : np.searchsorted(row, row[i], "right")].tolist()) for i in range(len(row))]
    order = suffix_dedup.suffix_order(row, symbol)
    assert [keys[i] for i in order] == sorted(keys)


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts, True)).collect()}
    assert {got[i].class_id for i in range(4)} == {0}
    assert got[7].class_id == got[8].class_id == 7  # empty and null
    assert all(got[i].class_id == i for i in (4, 5, 6, 9, 10, 11, 12, 13, 14))
    assert got[4].links == 0 and got[2].links >= 1
    assert near_dedup.one_of_each(frame(spark, texts)).count() == len({r.class_id for r in got.values()})


def test_near_duplicates_of_a_large_spread_group(spark):
    r, base = random.Random(9), prose(150, 20).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 5, 8))):
            words[r.randrange(150)] = f"w{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    bags = {i: np.sort([hash(" ".join(t.split()[k : k + 5])) & 0xFFFFFFFF for k in range(146)]) for i, t in rows}
    root = {i: i for i in bags}
    for i in bags:
        for j in range(i):
            if near_dedup.overlap(bags[i], bags[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == root and len(set(root.values())) > 1


def test_bagminhash_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    a = np.repeat(np.arange(40, dtype=np.uint64), r.integers(1, 9, 40))
    b = np.repeat(np.arange(20, 60, dtype=np.uint64), r.integers(1, 9, 40))
    salt = np.arange(60)
    hits, want = 0, near_dedup.overlap(np.sort(a), np.sort(b))
    for k in range(60):
        x, y = (np.uint64(k * 1000) + v for v in (a, b))
        s = near_dedup.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2, 190)
        hits += (s[0] == s[1]).mean()
    assert abs(hits / len(salt) - want) < 0.03


def test_packing_round_trip(spark, texts):
    rows = [*texts, (99, "a  b <|endoftext|>   c \n\n d"), (99, "x" * 5000)]
    pieces = packing.pack(frame(spark, rows, True)).toPandas()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = Counter(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in rows)
    pieces = pieces.sort_values(["sequence_id", "offset"])
    whole, sizes = b"".join(pieces.ids), pieces.groupby("sequence_id").length.sum()
    assert (pieces.offset.to_numpy() == pieces.groupby("sequence_id").length.cumsum().to_numpy() - pieces.length.to_numpy()).all()
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and sizes.index.tolist() == list(range(len(sizes)))
    assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(pieces.ids, pieces.ids_crc32, pieces.length))
    got, at = Counter(), 0
    for start, n, total in zip(pieces.start, pieces.length, pieces.doc_tokens):
        if start == 0:
            got[whole[at * 4 : (at + total) * 4]] += 1
        at += n
    assert got == want


def test_op2_ids_are_those_of_the_tokenizer_file(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from cohortloom.llm.queries import op2

    mark = "<|endoftext|>"
    rows = [(1, f"a {mark} b"), (2, mark), (3, f"{mark}{mark} x"), (4, f"  y  {mark}\n\n z{mark[:-1]}"), (5, None), (None, "nul \0 in \0\0 it"), (7, "x" * 9000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {d: [*own.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    got = op2(spark, str(tmp_path)).toPandas()
    assert got.length.sum() == sum(map(len, want.values()))
    for r in got.itertuples():
        ids = want[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/\r\n", big), (2, "b", big), (3, None, big), (4, "d", "small"), (5, "e", "small"), (6, "f", None), (None, "g", "x" * 2000), (8, "h", "x" * 2000)]
    for wide in (False, True):
        done = warc_zip.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS size"), zip64=wide)
        got = {r.page_id: r for r in warc_zip.read_archives(done).collect()}
        assert len(got) == len(rows)
        assert [got[i].record_type for i in (1, 2, 3, 4, 5, 6)] == ["revisit", "revisit", "response", "response", "response", "response"]
        assert got[1].refers_to == 3 and got[3].refers_to is None and got[None].refers_to == 8
        for page, _, html in rows:
            raw = (html or "").encode()
            assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            assert got[page].payload is None or bytes(got[page].payload) == raw


def test_zip_is_readable_by_others():
    import io
    import zipfile

    data, _ = warc_zip.pack_zip([("a", b"one"), ("ü", b""), ("index.cdxj", json.dumps({}).encode())], zip64=True)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("x", "stored")
    raw = made.getvalue()
    assert warc_zip.Archive(lambda a, n: raw[a : a + n], len(raw)).read("x") == b"stored"
    with pytest.raises(ValueError):
        warc_zip.Archive(lambda a, n: b"junk" * 30, 120)


def test_toxicity_grammar_and_learning(spark):
    score = toxicity.Scorer({"idiot": 4.0})
    plain, negated, reported, aimed = (score(t)[0] for t in ("an idiot here", "not an idiot", "he wrote an idiot came", "you are an idiot"))
    assert negated < plain and reported < aimed and aimed > plain
    assert score("kill the process")[0] < score("i will tell you this: you i kill")[0]
    assert score("") == (0.0, 0.0, 0.0)
    rows = [(i, prose(40, i) + (" zorgo" + "abc"[i % 3] + "x" if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (401, 0, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, *toxicity.learn(docs, labels)).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(400)) and got[400] == got[401] < 0.3
    lexicon, _ = toxicity.learn(docs, labels.limit(0))
    assert set(lexicon) == set(toxicity.INSULTS)


def test_language_held_out(spark):
    tongues = {"en": "the and of to in that with thing", "de": "der und die nicht schön über mit straße", "fr": "le été garçon où avec vous être", "zz": "你好 世界 中文 文字"}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(t.split()) for _ in range(20)), k) for i in range(300) for k, t in [list(tongues.items())[i % 4]]]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "12 !?", "de"), (902, "", None), (None, "the thing", "en")], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.predict(df, language.learn(df)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language.learn(df.filter("lang = 'none'")) is None
    assert {x.lang_pred for x in language.predict(df, None).collect()} == {"und"}


def test_decontamination(spark):
    item = prose(30, 77)
    words = item.split()
    swapped = " ".join("other" if i in (4, 11, 18, 25) else w for i, w in enumerate(words))
    rows = [(1, prose(20, 1) + " " + item.upper() + " " + prose(20, 2)), (2, swapped), (3, prose(20, 3) + " " + " ".join(words[:15])), (4, prose(300, 4)), (5, " ".join(reversed(words))), (6, None), (7, "")]
    items = spark.createDataFrame([(1, item), (1, item), (2, "a b"), (3, None), (4, prose(12, 99))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows, True).drop("item_id"), items).collect()}
    assert [got[i].contaminated for i in range(1, 8)] == [True, True, True, False, False, False, False]
    assert got[1].items == [1] and got[1].similarity == 1.0 and abs(got[2].similarity - 26 / 30) < 1e-9
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), items).collect()) == [4, 5, 6, 7]


def test_licenses(spark):
    rows = [(i, prose(i * 7 % 40, i) + " " + n + " " + prose(i * 5 % 33, i + 50)) for i, (_, n) in enumerate(licenses.TEMPLATES)]
    rows += [(90, None), (91, ""), (92, "licensed"), (93, prose(300, 9)), (94, "Licensed under the"), (None, licenses.TEMPLATES[1][1])]
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(frame(spark, rows, True)).collect()}
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        assert got[i, name].containment == 1.0
    assert not [k for k in got if k[0] in (90, 91, 92, 93, 94)] and (None, "Apache-2.0") in got


def test_fingerprints(spark, texts):
    rows = [*texts, (200, texts[0][1])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows, True)).collect()}
    order = sorted((d for d, _ in rows), reverse=True)
    own = dict(rows)
    for i, d in enumerate(order):
        a, b = own[d] or "", own[order[(i + 1) % len(order)]] or ""
        m = len(a) // 2
        edited = a[: len(a) - m] + b[:m]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
    assert got[0].fingerprint == got[1].fingerprint == got[200].fingerprint != got[4].fingerprint
    assert got[7].fingerprint == "" and got[1].near_next == 1.0


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x")]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        suffix_dedup.dedup_suffixes(docs), substring_dedup.dedup_substrings(docs), near_dedup.near_duplicates(docs), packing.pack(docs),
        warc_zip.read_archives(warc_zip.write_archives(pages)), decontaminate.contamination(docs, items), licenses.scan_licenses(docs),
        fingerprints.fingerprints(docs), language.predict(docs, language.learn(docs)), toxicity.score_toxicity(docs, *toxicity.learn(docs, labels)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline

    bad = [(100 + i, prose(30, 300 + i) + " you idiot scum") for i in range(30)]
    item = prose(20, 500)
    rows = [*texts, *bad, (150, prose(5, 501) + " " + item)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(100 <= d < 130)) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d for d, _ in texts} - {1, 2, 3, 8}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (prose(60, 700 + i) for i in range(5))
    rows = [(None, a), (7, a), (None, b), (9, b), (None, c), (3, d), (3, e), (3, e)]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.class_id, r.links) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(None, 7, 0), (7, 7, 0), (None, 9, 0), (9, 9, 0), (None, None, 0), (3, 3, 0), (3, 3, 0), (3, 3, 0)])
    kept = Counter((r.doc_id, r.text) for r in near_dedup.one_of_each(docs).collect())
    assert kept == Counter([(7, a), (9, b), (None, c), (3, d), (3, e)])


def test_toxicity_reads_clauses_from_their_first_token():
    score, far = toxicity.Scorer({"idiot": 4.0}), " thing" * 30
    assert score(f"he wrote{far} idiot")[0] == pytest.approx(0.6 * 4.0)
    assert score(f"you{far} kill")[0] == pytest.approx(1.5)
    assert score(f"he wrote{far}. the idiot")[0] == 4.0 and score(f"you{far}. then kill")[0] == pytest.approx(0.2 * 1.5)
    assert score(f"he wrote idiot{far} idiot")[0] == pytest.approx(0.6 * 4.0 * (1.3 + 1))  # "he" is near the first


def test_fingerprints_estimate_generalised_jaccard(spark):
    r, rows = random.Random(3), []
    words = prose(80, 900).split()
    for i in range(60):  # each document is an edit of the one before it
        words = [r.choice(WORDS) if r.random() < 0.02 * (i % 8) else w for w in words]
        rows.append((i, " ".join(words)))
    own = dict(rows)

    def alike(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / sum((a | b).values())

    off = []
    for x in fingerprints.fingerprints(frame(spark, rows)).collect():
        a, b = own[x.doc_id], own[(x.doc_id - 1) % 60]
        m = len(a) // 2
        off += [x.near_edited - alike(a, a[: len(a) - m] + b[:m]), x.near_next - alike(a, b)]
        assert abs(x.near_edited * 32 - round(x.near_edited * 32)) < 1e-9 and len(x.fingerprint) == 8 * 32
    assert max(map(abs, off)) < 0.35 and abs(np.mean(off)) < 0.03 and np.sqrt(np.mean(np.square(off))) < 0.09


def test_licenses_tell_versions_and_variants_apart(spark):
    rows = [(i, f"{prose(9, i)} {n} {prose(9, i + 90)}") for i, (_, n) in enumerate(licenses.TEMPLATES)]
    rows += [(100, " ".join(n for _, n in licenses.TEMPLATES if "version" in n)), (101, f"{licenses.BSD2} {prose(60, 1)} {licenses.BSD3}")]
    got = {}
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(got[i] == {name} for i, (name, _) in enumerate(licenses.TEMPLATES))
    assert got[100] == {name for name, n in licenses.TEMPLATES if "version" in n} and got[101] >= {"BSD-2-Clause", "BSD-3-Clause"}


def test_suffix_dedup_sorts_no_shards(spark, texts, monkeypatch):
    def sort(*_):
        raise AssertionError("sorted without use")

    monkeypatch.setattr(suffix_dedup, "suffix_order", sort)
    assert suffix_dedup.dedup_suffixes(frame(spark, texts)).count() == len(texts)


def test_language_of_texts_with_nul(spark):
    r, base = random.Random(8), prose(30, 5)
    texts = ["a\x00b\x00\x00\x00c", "\x00\x00\x00\x00", base, "", "é" * 400, "x\x00" * 50]
    whole = language.presence(texts)
    for i, t in enumerate(texts):
        assert (whole[i] == language.presence([t])[0]).all()
    assert (language.presence(["ab\x00cd"]) == language.presence(["ab cd"])).all() and not language.presence([""]).any()
    tongues = {"en": "the and of to in that with thing", "zz": "你好 世界 中文 文字"}
    rows = [(i, ("\x00" * (i % 5)).join(r.choice(t.split()) for _ in range(20)), k) for i in range(200) for k, t in [list(tongues.items())[i % 2]]]
    df = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS x", "3 AS lang_pred")
    got = language.predict(df, language.learn(df)).collect()
    assert len(got) == 203 and all(x.lang_pred == list(tongues)[x.doc_id % 2] for x in got)


def test_fingerprints_of_repeated_rows(spark):
    rows = [(1, prose(40, 1)), (2, prose(30, 2)), (2, prose(30, 2)), (2, prose(30, 2)), (3, prose(30, 3)), (3, prose(30, 3)), (None, prose(40, 1)), (4, None)]
    got = fingerprints.fingerprints(frame(spark, rows)).collect()
    once = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, list(dict.fromkeys(rows)))).collect()}
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(r == once[r.doc_id] for r in got) and once[1].fingerprint == once[None].fingerprint


def test_licenses_in_long_texts_and_damaged_notices(spark):
    notice = dict((n, t) for n, t in licenses.TEMPLATES)["ISC"].split()
    rows = [(1, prose(5000, 1) + " of the in the " + " ".join(notice) + " " + prose(5000, 2)), (2, " ".join(notice[:9] + ["other"] + notice[10:])), (3, "of the and the in the of the " * 300)]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(frame(spark, rows, True)).collect()}
    assert got == {(1, "ISC"), (2, "ISC")}


def test_fingerprints_count_terms_within_rows(spark, monkeypatch):
    plans, stored = {}, fingerprints.C.stored
    monkeypatch.setattr(fingerprints.C, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stored(df, name))
    rows = [(1, "aa bb aa"), (1, "aa bb aa"), (2, ""), (3, None), (4, "bb cc"), (None, " ")]
    got = fingerprints.fingerprints(frame(spark, rows))
    final = got._jdf.queryExecution().optimizedPlan().toString()
    # No group per term, one join of the texts with their heads, and what is wide is joined once by its own key.
    assert "term" not in " ".join(re.findall(r"Aggregate \[[^\]]*\]", plans["fingerprints"]))
    assert plans["fingerprints"].count("substring(text") == 2 and final.count("Join") == 3
    assert sorted((r.doc_id or 0, r.n_chars) for r in got.collect()) == [(0, 1), (1, 8), (1, 8), (2, 0), (3, 0), (4, 5)]
