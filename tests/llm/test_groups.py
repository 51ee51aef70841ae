"""Groups dealt out in blocks, components in rounds, and set joins, against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinoframe.llm import chat, groups, langid, line_dedup, minhash, mixing, quality, setjoin, substring, toxicity


def reachable(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_of_paths_stars_and_clouds(spark, monkeypatch, at_once):
    monkeypatch.setattr(groups, "EDGES_AT_ONCE", at_once)
    rnd = random.Random(3)
    ids = rnd.sample(range(10_000), 300)
    edges = list(zip(ids[:60], ids[1:60], strict=False)) + [(ids[70], x) for x in ids[71:120]] + [(rnd.choice(ids[130:]), rnd.choice(ids[130:])) for _ in range(90)]
    got = groups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == reachable([e for e in edges if e[0] != e[1]])
    assert len(got) == len({r["id"] for r in got})


def test_large_groups_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK_ROWS", 4)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(1000)}" for _ in range(60)]
    texts = []
    for _ in range(60):  # edits that leave some pairs over and some under the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split(" ")[k : k + 3]) for k in range(58)} for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = {i: i for i in range(60)} | reachable(links)
    got = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < 60


@pytest.mark.parametrize(("most", "block"), [(2048, 4096), (3, 5)])
def test_lines_of_families_in_blocks(spark, monkeypatch, most, block):
    monkeypatch.setattr(setjoin, "MOST_POSTINGS", most)
    monkeypatch.setattr(setjoin, "ROWS_AT_ONCE", 20 if most == 3 else 100_000)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rnd = random.Random(6)
    bases = [[f"w{rnd.randrange(400)}" for _ in range(n)] for n in (12, 12, 30, 150)]
    lines = []
    for _ in range(120):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(50)}"
        lines.append(" ".join(w))
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(40)]
    docs += [(None, lines[0]), (7, docs[7][1])]  # a row without an id, a repeated row
    sets = [frozenset(x.split(" ")) for x in lines]
    distinct = set(sets)
    near = {s: {t for t in distinct if t != s and 100 * len(s & t) >= 80 * len(s | t)} for s in distinct}
    first = {s: sets.index(s) for s in distinct}
    gone = [first[s] < k or any(first[t] < k for t in near[s]) for k, s in enumerate(sets)]
    got = {r["doc_id"]: r for r in line_dedup.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(40):
        assert got[i]["removed"] == [k for k in range(3) if gone[3 * i + k]]
        assert got[i]["n_links"] == sum(len(near[sets[3 * i + k]]) for k in range(3)) * (2 if i == 7 else 1)
    assert got[None]["removed"] == []


def test_paths_of_blocks_equal_all_paths():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(9, chat.STATES, chat.STATES))
    count = np.array([4, 1, 4])
    paths = chat.best_paths(m, count, np.array([-1, 2, 0]), np.array([-1, -1, 3]))
    for first, n, begin, end in ((0, 4, None, None), (4, 1, 2, None), (5, 4, 0, 3)):
        best = None
        for path in np.ndindex(*[chat.STATES] * (n + 1)):
            if (begin is None or path[0] == begin) and (end is None or path[-1] == end):
                score = sum(m[first + k, path[k], path[k + 1]] for k in range(n))
                best = max(best, (score, path[1:])) if best else (score, path[1:])
        assert tuple(paths[first : first + n]) == best[1]
    whole = chat.products(m, count)
    for k, (first, n) in enumerate(((0, 4), (4, 1), (5, 4))):
        want = m[first]
        for x in m[first + 1 : first + n]:
            want = (want[:, :, None] + x[None]).max(axis=1)
        assert np.allclose(whole[k], want)


def test_chat_on_odd_tables(spark):
    model = chat.fit(spark.createDataFrame([], "conv long, pos long, role string, text string"))
    schema = "conv long, pos long, text string, role string, tie string"
    assert chat.parse_transcripts(spark.createDataFrame([], schema), model).count() == 0
    rows = [(None, None, None, "", ""), (1, 0, "User: hi\nAssistant: yes", "", ""), (1, 0, "User: hi\nAssistant: yes", "", ""), (1, 1, "more " * 2000 + "\n" * 300, "", ""), (1, None, "", "", ""), (2, 5, "System: be", "", "")]
    rows += [(3, k, "User: a?" if k % 2 else "Assistant: b", "", "") for k in range(150)]
    got = chat.parse_transcripts(spark.createDataFrame(rows, schema), model).collect()
    assert {(r["conv"], r["pos"]) for r in got} == {(r[0], r[1]) for r in rows}
    assert [r["role"] for r in sorted((r for r in got if r["conv"] == 3), key=lambda r: r["pos"])] == ["assistant", "user"] * 75
    text = "\n".join(r["rendered"] for r in sorted((r for r in got if r["conv"] == 3), key=lambda r: r["pos"]))
    assert text.count("<|end|>") == 150 and text.startswith("<|assistant|>\nb\n<|end|>\n<|user|>") and text.endswith("<|end|>")


def test_forward_sums_all_segmentations():
    rnd = random.Random(1)
    pieces = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(14)} | {langid.MARK, langid.MARK + "a"})
    s, p = langid.Segmenter(pieces), np.random.default_rng(1).random((len(pieces) + 1, 3)) * 0.2
    p[-1] = 0

    def brute(word, k):
        if not word:
            return 1.0
        out = langid.UNKNOWN * brute(word[1:], k)
        return out + sum(p[i, k] * brute(word[len(x) :], k) for i, x in enumerate(pieces) if word.startswith(x))

    words = ["a", "ab", "babba", "abcab", "bbbbaaaabb"]
    got = s.log_probability(words, p)
    assert np.allclose(got, [[np.log(brute(langid.MARK + w, k)) for k in range(3)] for w in words])
    # a word of any length: twice the letters, twice the logarithm or so, and no underflow
    one, two = s.log_probability(["ab" * 2500, "ab" * 5000], p)
    assert np.isfinite(two).all() and np.allclose(two / one, 2, rtol=0.01)
    # expected uses by enumeration
    use, word = np.zeros(len(pieces)), langid.MARK + "babba"

    def walk(rest, weight, used):
        if not rest:
            for i in used:
                use[i] += weight
            return
        walk(rest[1:], weight * langid.UNKNOWN, used)
        for i, x in enumerate(pieces):
            if rest.startswith(x):
                walk(rest[len(x) :], weight * p[i, 0], [*used, i])

    walk(word, 1.0, [])
    assert np.allclose(s.expected(["babba"], np.array([3.0]), p[:, :1]), 3 * use / brute(word, 0))


def test_many_languages_are_all_learned(spark, tmp_path):
    from kinoframe.llm import queries

    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 8, f"l{i:03d}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.PIECE_BPE)
    assert len(model[0]) == 300 and model[2].shape[1] == 300


def test_mixing_solves_the_dual(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(1, 80), "abc"[i % 3]) for i in range(90)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    sizes = {s: part["size"].sum() for s, part in got.groupby("source")}
    # targets by hand: 5, 2, 1 of 150 %, held under twice the source
    weight, total = {"a": 5, "b": 2, "c": 1}, 1.5 * sum(sizes.values())
    target = {s: total * w / 8 for s, w in weight.items()}
    if target["a"] > 2 * sizes["a"]:
        over = total - 2 * sizes["a"]
        target = {"a": 2.0 * sizes["a"], "b": over * 2 / 3, "c": over / 3}
        if target["b"] > 2 * sizes["b"]:
            target |= {"b": 2.0 * sizes["b"], "c": min(over - 2 * sizes["b"], 2.0 * sizes["c"])}
    for s, part in got.groupby("source"):
        assert abs(part["target"].iloc[0] - target[s]) < 1e-6
        n = part["size"].to_numpy(float)
        x, lam = n / n.mean(), 0.0
        if target[s] < 2 * n.sum():
            low, high = -200.0, 200.0
            for _ in range(200):  # bisection on the one dual variable of a source
                lam = (low + high) / 2
                low, high = (lam, high) if (n * 2 / (1 + np.exp(-lam * x))).sum() < target[s] else (low, lam)
            assert np.allclose(part["rate"], 2 / (1 + np.exp(-lam * x)), atol=1e-4)
        else:
            assert (part["rate"] == 2).all()
    clash = spark.createDataFrame([(1, "a b", "s", 3)], "doc_id long, text string, source string, _copies int")
    assert mixing.mixed_documents(clash).columns == clash.columns


def test_quality_distances_and_other_languages(spark):
    rnd = random.Random(7)
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    en, ru = [*quality.COMMON["en"], "House", "river", "stone", "green", "x1"], ["Дом", "река", "камень", "зелёный", "вода", "свет", "небо", "трава"]
    rows = [(i, say(en, 300), "en") for i in range(40)] + [(100 + i, say(ru, 300), "ru") for i in range(25)] + [(200, say(ru, 300), "xx"), (201, say(ru, 300), None), (202, say(["||", "##", "%%", "$$", "9"], 400), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in got if i != 202) and not got[202]["kept"]
    refs = {"en": ([0.5, 0.1, 0.1, 0.2, 0.05, 0.0, 0.05], [0.6] + [0.0] * (len(quality.BINS) - 1) + [0.4])}
    counts = quality.base_counts(docs.where("doc_id < 5"))
    for r in quality.judge(counts, refs).collect():
        for name, c, ref in (("class_distance", r["classes"], refs["en"][0]), ("common_distance", r["common"], refs["en"][1])):
            p, q = np.array(c) / sum(c), np.array(ref)
            m = (p + q) / 2
            kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)  # noqa: E731, B023
            assert abs(r[name] - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_toxicity_lowers_its_own_risk():
    rnd = random.Random(11)
    positive = [np.array(sorted({0, rnd.randrange(2, 30)}), np.int32) for _ in range(60)]
    clean = [np.array(sorted({1, rnd.randrange(2, 30)}), np.int32) for _ in range(300)]
    unlabelled, prior = clean + positive[:30], 0.1
    w, b = toxicity.fit_nnpu(positive, unlabelled, 30, prior)

    def risk(w, b):
        s = lambda rows: np.array([1 / (1 + np.exp(-(w[r].sum() + b))) for r in rows])
        p, u = s(positive), s(unlabelled)
        return prior * (1 - p).mean() + max(0.0, u.mean() - prior * p.mean())

    best = risk(w, b)
    assert best < 0.1 * risk(np.zeros(30), 0.0)
    assert all(w[r].sum() + b > 0 for r in positive) and all(w[r].sum() + b < 0 for r in clean)


def test_special_tokens_are_the_tokenizers(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from kinoframe.llm import packing, queries

    plain, texts = Tokenizer.from_file(queries.WORD_BPE), ["a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|>", "<|end", ""]
    flat, ends = packing.encoder_of(queries.WORD_BPE).ids(pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
    rows = [(None, "a b c " * 40)] * 30 + [(5, "d e f")] * 30 + [(5, None)]
    out = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.WORD_BPE).toPandas()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() <= 4096


def test_exact_groups_of_null_and_shared_ids(spark):
    from kinoframe.llm import exact_dedup

    rnd = random.Random(12)
    texts = ["".join(rnd.choice("abcd") for _ in range(700)) for _ in range(30)]
    rows = [((None, 5, 9)[i % 3], t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (7, texts[1]), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (3, 64):
        for r in exact_dedup.exact_groups(docs, hash_bits=bits).collect():
            same = [i for i, t in rows if __import__("hashlib").sha256((t or "").encode()).hexdigest() == r["text_sha256"]]
            assert r["group_size"] == len(same) and r["keep_id"] == max((x for x in same if x is not None), default=None)
    got = exact_dedup.drop_exact_copies(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, "a")]


def test_released_tables_are_gone(spark):
    from kinoframe.llm.common import durable, purge

    made = durable(spark.range(3), "t")
    path = made._durable_path.removeprefix("file:")
    assert made.agg(F.sum("id")).first()[0] == 3
    purge(spark)
    assert not __import__("os").path.exists(path)


def test_windows_are_verified_on_words(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
    passage = text(90)
    texts = [text(200), passage + " " + text(60), "x " * 300, text(40) + " " + passage, "x " * 120 + passage, text(900), passage, passage, "y " + "x " * 60 + "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, true = set(), {}
    for d, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        true[d] = len({i + k for i, x in enumerate(windows) if x in seen for k in range(50)})
        seen.update(windows)
    whole = {r.doc_id: r.n_removed for r in substring.substring_verdicts(docs).collect()}
    assert whole == true and sum(true.values()) > 400
    # with hashes of six bits most windows collide: nothing goes that must stay
    few = {r.doc_id: r.n_removed for r in substring.substring_verdicts(docs, hash_bits=6).collect()}
    assert all(few[d] <= true[d] for d in true)


def test_index_is_kept_between_jobs(spark, tmp_path):
    rnd = random.Random(9)
    passage = " ".join(rnd.choice(["ab", "cd", "ef", "gh"]) for _ in range(70))
    first = spark.createDataFrame([(1, "one two " + passage), (2, None)], "doc_id long, text string")
    later = spark.createDataFrame([(5, passage + " three"), (6, "four")], "doc_id long, text string")
    index = substring.FingerprintIndex(spark)
    assert {r.n_removed for r in index.add_batch(first).collect()} == {0}
    index.save(str(tmp_path / "index"))
    again = substring.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert {r.doc_id: r.n_removed for r in again.add_batch(later, first).collect()} == {5: 70, 6: 0}
