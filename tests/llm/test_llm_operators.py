"""Small cases of every operator: brute force, nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import hashlib
import zlib

import numpy as np
import pytest

from fieldloom.llm import capfilters, chat, components, decontaminate, html_extract, html_training, mixing, sharding, simhash, suffix_dedup, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, block long, _there int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None or i % 3 == 0 else "en", None if i is None or i % 5 == 0 else "s" + "ab"[i % 2], 1, 2, "k", 3, 4) for i, t in rows], DOCS)


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in r.integers(0, 5000, n))


@pytest.fixture(scope="session")
def docs(spark):
    long_text = words(1, 30_000)
    rows = [(1, long_text), (2, long_text), (3, long_text + " end"), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "ONE"), (None, "lost"), (9, words(2, 200)), (9, words(2, 200)), (10, "é ß   x " * 300)]
    rows += [(20 + k, words(3, 300) + f" t{k}") for k in range(12)] + [(40 + k, words(50 + k, 150)) for k in range(20)]
    return frame(spark, rows)


def empty(docs):
    return docs.where("doc_id = -1")


def test_sharding(docs):
    r = sharding.kd_shards(docs, 5).toPandas()
    p = docs.toPandas()
    assert len(r) == len(p) and set(r.law) == {"bytes"} and r.grown_shard.isna().all()
    for s, x in r.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x))) and 0 <= s < 5
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in p.text)
    assert sorted(zip(r["size"], r.text_crc32)) == want
    assert sharding.kd_shards(empty(docs), 5).count() == 0


def test_sharding_balances_a_hot_source(spark):
    d = frame(spark, [(5 * k if k % 3 == 0 else k, "x" * (20 + k % 50)) for k in range(3000)])
    size = sharding.kd_shards(d, 7).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(size) == 7 and size.max() < 1.05 * size.min()


def test_simhash_matches_brute_force(docs):
    r = simhash.near_duplicates(docs).toPandas()
    p = docs.toPandas()
    assert len(r) == len(p)
    fp = {simhash.fingerprint(t or "") for t in p.text}
    assert {f"{f & (2**64 - 1):016x}" for f in fp} == set(r.fingerprint)
    k = r[r.doc_id.notna()].reset_index()
    ids, h = k.doc_id.astype(int).to_numpy(), np.array([int(x, 16) for x in k.fingerprint], np.uint64)
    label = ids.copy()
    for _ in range(len(h)):
        for i in range(len(h)):
            j = np.bitwise_count(h[i] ^ h) <= 4
            label[j] = label[j].min()
    assert (label == k.component_id.astype(int)).all()
    assert r[r.doc_id.isna()].component_id.isna().all()
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 9").count() == 1 and kept.where("doc_id is null").count() == 1


def test_simhash_tiles_meet():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**64, 700, np.uint64)
    a = np.unique(np.concatenate([a, a[:300] ^ np.uint64(5), a[:300] ^ np.uint64(0xF000000000000000)]))
    got = {(min(i, j), max(i, j)) for x, y in simhash.near(a, a, 4, True) for i, j in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 4).tolist() if i < j}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 140)}


@pytest.mark.parametrize("largest", [50_000, 2])
def test_repeated_strings_match_brute_force(docs, largest):
    n = 40
    small = docs.where("doc_id is null or doc_id > 3")
    rows = [((t or "").encode()) for t in small.toPandas().text]
    seen = {}
    for b in rows:
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]] = seen.get(b[k : k + n], 0) + 1
    want = []
    for b in rows:
        cut = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                cut[k : k + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cut[:-1]])
        want.append((len(b), int(cut.sum()), int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.without_repeats(small, n, largest).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert suffix_dedup.without_repeats(empty(docs), n).count() == 0


def test_mixture(docs):
    r = mixing.mixture(docs, budget_share=0.5, target_entropy=0.99, max_repeat=2.0).toPandas()
    p = docs.toPandas()
    p["n"] = [len((t or "").encode().split()) for t in p.text]
    assert r.n_tokens.sum() <= 0.5 * p.n.sum()
    total = p.n.groupby(p.source.fillna("")).sum()
    assert all(r[r.source == s].n_tokens.sum() <= 2 * total[s] for s in total.index)
    taken = mixing.mixed(docs, budget_share=0.5)
    assert taken.columns == docs.columns and taken.count() < len(p)
    assert mixing.mixture(empty(docs)).count() == 0


def test_mixture_goes_past_a_long_row(spark):
    # All rows are of one source; by these seeds the long row is among the first three.
    d = frame(spark, [(5 * 3 * k, "w " * (900 if k == 1 else 10)) for k in range(1, 11)])
    for seed in (4, 5):
        used = mixing.mixture(d, budget_share=0.1, max_repeat=1.0, seed=seed).collect()
        assert sorted(r.n_tokens for r in used) == [10] * 9
        assert sorted(r.doc_id for r in mixing.mixed(d, budget_share=0.1, seed=seed).collect()) == sorted(r.doc_id for r in used)


def test_exponent_meets_its_target(spark):
    t = spark.createDataFrame([("a", 900_000), ("b", 90_000), ("c", 10_000)], "source string, tokens long")
    p = np.array([0.9, 0.09, 0.01])
    entropy = lambda a: -(q := p**a / (p**a).sum()) @ np.log(q)
    a = mixing.exponent(t, 1_000_000, 0.8, None)
    assert abs(entropy(a) - 0.8 * np.log(3)) < 1e-6
    a = mixing.exponent(t, 1_000_000, 1.0, 3.0)
    q = p**a / (p**a).sum()
    assert abs((q * 1_000_000 / (p * 1_000_000)).max() - 3) < 1e-6


def test_toxicity(spark, docs):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(1, 400):
        bad = k % 4 == 0
        t = words(k, 60).split()
        if bad:
            t[int(r.integers(60))] = "horrid" + str(k % 7)
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(bad), 0))
    lab = spark.createDataFrame(labels + [(None, 1, 1, 0), (3, 1, None, 0)], "doc_id long, quality int, toxic int, text int")
    d = frame(spark, rows + [(None, "x"), (5000, None), (5001, "")])
    got = toxicity.toxicity(d, lab).toPandas()
    held = got[got.held_out]
    assert set(held.doc_id.astype(int)) == {k for k, _ in rows + [(5000, 0), (5001, 0)] if zlib.crc32(str(k).encode()) % 5 == 0}
    known = got[got.doc_id.between(1, 399)]
    assert ((known.doc_id % 4 == 0) == (known.predicted == 1)).mean() > 0.95 and len(got) == len(rows) + 3
    assert set(toxicity.toxicity(d, lab.where("toxic = 7")).toPandas().predicted) == {0}
    assert toxicity.toxicity(empty(docs), lab).count() == 0
    assert toxicity.without_toxic(d, lab).columns == d.columns


def test_machine_learns_a_pair():
    r = np.random.default_rng(1)
    x = r.random((3000, 6)) < 0.5
    rows = [np.sort(np.flatnonzero(row).astype(np.uint64) + np.uint64(10)) for row in x]
    y = (x[:, 0] & x[:, 1] | ~x[:, 0] & ~x[:, 1]).astype(np.int64)
    m = toxicity.fit_machine(rows, y, epochs=80)
    m_pair = m.factors @ m.factors.T
    assert abs(m_pair[np.searchsorted(m.ids, 10), np.searchsorted(m.ids, 11)]) > 0.5


def test_decontamination(spark, docs):
    item = "On Monday the tall baker sold 12 kg of bread to Anna and then he gave 3 loaves to Bob before the shop closed"
    changed = item.replace("12", "55").replace("3 ", "9 ").replace("Anna", "Clara").replace("Bob", "Dora")
    crossed = item.replace("Bob", "Anna")
    b = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, item), (4, "seven words make this one short item")], "item_id long, text string")
    rows = [(1, "Well. " + item + ". The end"), (2, "x y z " + changed + " more"), (3, crossed), (4, None), (5, ""), (6, words(1, 5000)), (7, "here seven words make this one short item is"), (None, item), (8, item[:40])]
    for looked_up in (1000, 0):
        got = sorted(map(tuple, decontaminate.contaminated(frame(spark, rows), b, looked_up).select("doc_id", "item_id", "n_slots", "n_changed").collect()))
        assert [g[:2] for g in got] == [(1, 1), (2, 1), (7, 4)] and got[0][3] == 0 and got[1][3] >= 4
    assert decontaminate.contaminated(empty(docs), b).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), b.where("item_id = 99")).count() == 0
    assert {r.doc_id for r in decontaminate.decontaminated(frame(spark, rows), b).collect()} == {3, 4, 5, 6, 8, None}


def matched(spark, items, rows, looked_up=1000):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in decontaminate.contaminated(frame(spark, rows), b, looked_up).select("doc_id", "item_id").collect()}


def test_decontamination_in_another_case(spark):
    item = "On Monday the tall baker sold 12 kg of bread to Anna and then he gave 3 loaves to Bob before the shop closed"
    loud = "EVERY WORD OF THIS ITEM STANDS IN CAPITALS AND THERE ARE 3 OF THEM"
    items = [(1, item), (2, loud), (3, "12 15 18 21 24 27 30 33 36 39")]
    rows = [(1, "x " + item.upper() + " y"), (2, item.title()), (3, item.lower()), (4, "So every word of this item stands in capitals and there are 3 of them."), (5, "so 12 15 18 21 24 27 30 33 36 39 it is"), (6, "13 15 18 22 24 28 30 33 37 39")]
    for looked_up in (1000, 0):
        assert matched(spark, items, rows, looked_up) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_decontamination_with_other_names(spark):
    item = "Tom has 12 red apples. Tom gives 4 to Ann. How many apples does Tom have left?"
    bob, mary = item.replace("Tom", "Bob"), item.replace("Tom", "Mary Jones")
    long = "early that day the old baker went out to the market and sold all of his bread before noon on the same day again"
    rows = [(1, bob), (2, mary), (3, mary.replace("12", "30").replace("Ann", "Lee Ray Fox")), (4, "Well. The rest is other prose. " + bob), (5, long.replace("sold", "with joy sold"))]
    rows += [(6, "the baker went to the market and sold all that remained of the bread"), (7, "Red apples are many. How many does Tom have left?")]
    for looked_up in (1000, 0):
        assert matched(spark, [(1, item), (2, long)], rows, looked_up) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}
    assert list(decontaminate.chains([(0, 5), (1, 6), (2, 9), (0, 50)])) == [[(0, 5), (1, 6), (2, 9)], [(0, 50)]]


def test_decontamination_with_equal_values(spark):
    item = "A farmer sold 3 eggs and 5 loaves to Anna and Bob, then walked home with 7 coins and fed all of the hens, the cow and the 3 old dogs before it was dark outside"
    rows = [(1, item.replace("3", "4").replace("5", "4")), (2, item.replace("Anna", "Clara").replace("Bob", "Clara")), (3, item.replace("the 3 old", "the 9 old")), (4, item.replace("Bob", "Anna"))]
    assert matched(spark, [(1, item)], rows) == {(1, 1), (2, 1), (3, 1)}
    assert decontaminate._agree([{("u1", "u2")}, {("u1", "u3")}, {("u1", "u3"), ("u4", "u3")}]) == ([1, 2], {("u1", "u3"), ("u4", "u3")})


def test_token_counts_match_the_library(spark, docs):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    vocabulary = tokens.read_vocabulary()
    t = Tokenizer(Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *vocabulary], 0, True))
    t.pre_tokenizer = Metaspace(prepend_scheme="always", split=True)
    more = frame(spark, [(100, "  a  b "), (101, "日本語 \n\n x\t"), (102, "▁a▁▁b"), (103, "aaaaaaaa" * 40)])
    for r in tokens.token_counts(docs.union(more)).join(docs.union(more).select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    assert tokens.token_counts(empty(docs)).count() == 0


def test_token_ties_go_to_the_first_beginning():
    c = tokens.Counter([("ab", -2.0), ("a", -1.0), ("b", -1.0), ("c", -5.0)])
    assert c.segment("ab") == (1, -2.0)
    assert c.segment("é") == (2, -15.0)


def test_chat(spark):
    rows = [(1, 0, "user", "a <|im_end|>\n <\\|im_end|> [INST] [\\/INST] <"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 5, "us%er\n<", "|im_start|>"), (2, None, "assistant", "</s>"), (None, 0, "user", "x")]
    rows += [(3, k, "user" if k % 2 == 0 else "assistant", "t" * k) for k in range(70)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.reply_chains(d)).select("tree", "text", chat.read_back().alias("back"), chat.loss_text().alias("loss")).collect()
    want = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0)):
        want.setdefault("" if i is None else str(i), []).append((role, text or ""))
    assert {r.tree: [(t.role, t.text) for t in r.back] for r in out} == want
    assert {r.tree: r.loss for r in out} == {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}
    assert all("[INST]" not in r.text and "</s>" not in r.text for r in out)
    assert chat.formatted(chat.reply_chains(d.where("conv_id = 99"))).count() == 0


def test_reply_trees(spark):
    kind = "tree string, node long, parent long, score double, role string, text string"
    d = spark.createDataFrame([("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 2.0, "assistant", "b"), ("t", 4, 2, 5.0, "user", "c"), ("u", 9, 77, None, "user", "z")], kind)
    assert {(r.tree, r.leaf, r.score, r.n_turns) for r in chat.formatted(d).collect()} == {("t", 3, 2.0, 2), ("t", 4, 6.0, 3), ("u", 9, 0.0, 1)}
    assert {r.leaf for r in chat.formatted(d, best=1).collect()} == {4, 9}
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("t", 1, 2, 0.0, "u", "x"), ("t", 2, 1, 0.0, "u", "y")], kind))


def test_cap_filters_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "DATA", 64)
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 32))
    x = np.concatenate([base, base[:30] + 0.1 * r.normal(size=(30, 32)) * np.abs(base[:30]).mean(), base[:1] + 0.02 * r.normal(size=(300, 32))]).astype(np.float32)
    label = [k % 2 if k < 90 else 0 for k in range(len(x))]
    rows = [(k, v.tolist(), b) for k, (v, b) in enumerate(zip(x, label))]
    odd = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] * 32, 0), (1003, [None] * 32, 0), (1004, rows[0][1], None), (1005, rows[0][1][:31], 0), (None, rows[0][1], 0), (1006, [], 0)]
    got = capfilters.near_vectors(spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<float>, label int")).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(comp, np.where(near, comp[None], 10**6).min(1))
        if (new == comp).all():
            break
        comp = new
    mine = got[got.vec_id < 1000].sort_values("vec_id")
    assert (mine.n_links.to_numpy() == near.sum(1)).all() and (mine.component_id.to_numpy() == comp).all()
    rest = got[~(got.vec_id < 1000)]
    assert len(rest) == len(odd) and (rest.n_links == 0).all() and rest.kept.all()


def test_html(spark):
    model = html_extract.fitted()
    wrong = total = 0
    for page, truth in html_training.labelled_pages(150, seed=99):
        blocks, labels = html_extract.aligned(page, truth)
        got = model.decode(blocks)
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.02
    page = '<nav><a href="/">Home</a></nav><article><h1>Title</h1><p>One &amp; two<br>three  four.<p><b>Five &lt;six&gt; &copy; seven eight.</article><footer>&copy; me</footer><script>x("</p>")</script>'
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<!-- open"), (3, "w", page)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    want = "Title\n\nOne & two three four.\n\nFive <six> © seven eight."
    assert sorted(got.text) == ["", "", "", want, want] and list(got.n_chars) == [len(t) for t in got.text]
