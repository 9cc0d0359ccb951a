import itertools
import math
import re

import numpy as np
import pytest

from fluvia.llm import decontaminate, graph, lsh_forest, wrapper


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed=6):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    texts = [None, "", " \n ", "one two", "One  two", "a b c d e", "a b c d e f", "long " * 3000, "long " * 3001]
    for size in (20, 60, 200, 200):
        base = word(size)
        texts += [" ".join(base)] * 3
        for _ in range(25):
            other = list(base)
            for k in rng.integers(0, size, rng.integers(1, 4)):
                other[k] = "x%d" % rng.integers(1e6)
            texts.append(" ".join(other))
    return [*texts, *[" ".join(word(int(n))) for n in rng.integers(1, 90, 40)]]


@pytest.mark.parametrize("block", [256, 7])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK_CLASSES", block)
    monkeypatch.setattr(lsh_forest, "SENT_MEMBERS", 0 if block == 7 else 500_000)
    texts = corpus()
    sets = [shingle_set(t) for t in texts]
    links, least = [0] * len(texts), list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8 - 1e-12]
    for a, b in near:
        links[a] += 1
        links[b] += 1
    for _ in range(50):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, comp string, n_links int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh_forest.jaccard_classes(df).collect()}
    assert got == {i: (least[i], links[i]) for i in range(len(texts))}


def test_least_depth_reaches_the_recall():
    missed = lambda depth: math.exp(lsh_forest.TREES * lsh_forest.log_miss(0.8, depth))
    depth = lsh_forest.least_depth()
    assert missed(depth) <= 1 - lsh_forest.RECALL < missed(depth + 1)


@pytest.mark.parametrize("rows, parts", [(100_000, 1), (40, 7)])
def test_forest_ties_all_that_meet(spark, monkeypatch, rows, parts):
    """The ties join every two classes whose common prefix in a tree is as long as the shortened prefix of either; none is shorter than the least."""
    monkeypatch.setattr(lsh_forest, "TRIE_ROWS", rows)
    rng = np.random.default_rng(4)
    trees, depth = lsh_forest.TREES, lsh_forest.DEPTH
    sigs = []
    for share in (0.0, 0.02, 0.05, 0.1, 0.2, 0.3):
        base = rng.integers(0, 256, trees * depth, dtype=np.uint8)
        for _ in range(12):
            other = base.copy()
            new = rng.random(len(base)) < share
            other[new] = rng.integers(0, 256, new.sum())
            sigs.append(other)
    sigs += [rng.integers(0, 256, trees * depth, dtype=np.uint8) for _ in range(20)]
    n = len(sigs)
    tries = np.array(sigs).reshape(n, trees, depth)
    common = np.logical_and.accumulate(tries[:, None] == tries[None], axis=3).sum(3)
    common[np.arange(n), np.arange(n)] = 0
    least, log = lsh_forest.least_depth(), [0, *[lsh_forest.log_miss(0.8, d) for d in range(1, depth + 1)]]
    longest = common.max(1)
    stop = [max(x for x in range(least, depth + 1) if x == least or sum(log[max(least, min(m, x))] for m in own) <= math.log(1 - lsh_forest.RECALL)) for own in longest.tolist()]
    assert len(set(stop)) > 2
    own = np.maximum(least, np.minimum(longest, np.array(stop)[:, None]))
    meets = (common >= np.minimum(own[:, None], own[None])).any(2)
    df = spark.createDataFrame([(i * 7 - 200, s.tobytes()) for i, s in enumerate(sigs)], "c long, sig binary")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ties = [((r["u"] + 200) // 7, (r["v"] + 200) // 7) for r in lsh_forest.met_classes(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    label = list(range(n))
    for _ in range(n):
        for a, b in ties:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[a] == label[b] for a, b in zip(*np.nonzero(meets)))
    assert all((common[a, b] >= least).any() for a, b in ties)


def test_forest_recall_of_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.8, alone and each amid near copies of one end, against brute force."""
    rng = np.random.default_rng(1)
    word = lambda n: [f"v{k}" for k in rng.integers(0, 10**6, n)]
    texts, pairs = [], []
    for k in range(150):
        base = word(104)
        other = base[:93] + word(11)
        pairs.append((len(texts), len(texts) + 1))
        texts += [base, other]
        for _ in range(8 * (k % 2)):
            copy = list(base)
            copy[int(rng.integers(104))] = "z%d" % rng.integers(10**6)
            texts.append(copy)
    sets = [shingle_set(" ".join(t)) for t in texts]
    assert all(0.8 <= jaccard(sets[a], sets[b]) < 0.82 for a, b in pairs)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in lsh_forest.jaccard_classes(df).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 148


def test_join_edge_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (9, "A b c d e f G"), (7, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in lsh_forest.jaccard_classes(df).collect())
    assert got == [("5", 5, 2), ("5", 5, 2), ("7", 7, 0), ("9", 5, 2), ("None", None, 0)]
    assert lsh_forest.jaccard_classes(df.where("false")).count() == 0
    assert sorted(str(r["doc_id"]) for r in lsh_forest.keep_one(df).collect()) == ["5", "7", "None"]


def test_keep_one_decides_by_row(spark):
    """Ids on several texts and null ids: one row of each group stays, and every unique text."""
    words = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    near = lambda k: words(k) + " more"
    rows = [(1, words("a")), (2, near("a")), (2, words("b")), (2, None), (2, ""), (3, words("c")), (3, near("c")), (4, near("c") + " yet"), (5, words("d")), (5, words("d")), (5, words("e"))]
    rows += [(None, words("f")), (None, words("f").upper()), (None, words("g")), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in lsh_forest.keep_one(df).collect()]
    assert len([g for g in got if g[0] == 3]) == 1 and 4 not in {d for d, _ in got}
    want = [(1, words("a")), (2, words("b")), (2, ""), (2, ""), (5, words("d")), (5, words("e")), (None, words("f")), (None, words("g")), (None, ""), (None, "")]
    assert sorted(map(str, (g for g in got if g[0] != 3))) == sorted(map(str, want))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "u long, v long")
    got = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def edit_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = np.random.default_rng(9)
    for _ in range(300):
        p, t = ("".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 30, 2))
        best, end = decontaminate.myers(p, t)
        assert best == edit_in(p, t)
        assert best == len(p) or edit_in(p, t[:end]) == best


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    items = [text(n) for n in (30, 80, 200, 19, 90)]
    items[4] = items[1]
    items += ["forty two. end", "Q7", "x"]
    docs = [None, "", text(500)]
    for item, edits in itertools.product(items, (0, 1, 3, 8, 14)):
        changed = list(item)
        for k in rng.integers(0, len(item), edits):
            changed[k] = rng.choice(["", "z", "zz"])
        docs.append(text(150) + "  " + "".join(changed).upper() + text(90))
    docs.append("".join(items) * 2)
    docs += ["Forty  two. End", "so forty two. ending", "twenty-forty two. end? q7", "xq7 q7x", "(x)", "forty two. end" * 2]
    assert decontaminate.Matcher([(1, "forty two. end")], 0.05).find("ab forty two. end") == [(1, 0, 3, 17)]
    canon = decontaminate.canonical
    want = set()
    for (i, d), (k, item) in itertools.product(enumerate(docs), enumerate(items)):
        if canon(item) and canon(d):
            least = edit_in(canon(item), canon(d))
            short = len(canon(item)) < 20
            if least <= decontaminate.budget(len(canon(item))) and (not short or re.search(r"(?<![^\W_])" + re.escape(canon(item)) + r"(?![^\W_])", canon(d))):
                want.add((i, k, least))
    monkeypatch.setattr(decontaminate, "BATCH_CHARS", 120)
    df = spark.createDataFrame([(i, d, "q") for i, d in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    found = decontaminate.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == want and len(found) == len(want)
    for r in found:
        assert edit_in(canon(items[r["item_id"]]), canon(docs[r["doc_id"]])[r["match_start"] : r["match_end"]]) == r["distance"]
    clean = {r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()}
    assert clean == set(range(len(docs))) - {d for d, *_ in want}
    assert decontaminate.leaks(df, bench.where("false")).count() == 0


PAGE = (
    '<html><head><title>t &am</title><script>var a="</p><article>";</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav>'
    '<div class="ad">buy {0}</div><article><header><h1>Head {0}</h1></header><p><b>One {0}&nbsp;&amp; two<br><p>Three<i>four</i>\n five {0}</p>'
    '<p>Always the same line</p><form>x</form><div class="comments"><p>Nice</p></div></article><aside>s</aside><footer>&copy; x</footer>'
)


def test_main_text_without_furniture():
    assert wrapper.extract(PAGE.format(7)) == "Head 7 One 7 & two Threefour five 7 Always the same line"
    plain = '<body><header>H</header><div id="sidebar">s</div><div><h2>T</h2>x<p>y</div><div class="cookie-notice">c</div><section id="comments">r</section>'
    assert wrapper.extract(plain) == "T x y"
    assert wrapper.extract(None) == wrapper.extract("") == ""
    assert wrapper.extract("just text &lt;b&gt; <") == "just text <b> <"
    assert wrapper.extract("<div>" * 3000 + "deep") == "deep"
    assert wrapper.extract("<p>a</p></div></b><p>b<!-- c --><![CDATA[d]]><script>e") == "a b"


def test_tree_matching_is_largest():
    node = lambda label, *children: [label, "", False, list(children), [], 0, 1]
    a = [node("p"), node("div", node("a"), node("b")), node("ul")]
    b = [node("div", node("a")), node("p"), node("div", node("a"), node("b")), node("ul")]
    assert wrapper.matched(a, b) == [(0, 1), (1, 2), (2, 3)]
    assert wrapper.matched(a[1:2], b[1:2]) == []


def test_deep_pages_of_differing_layouts_merge_quickly():
    """Each level differs by a sibling, so every level is matched by the full rule."""
    page = lambda k: "".join(f"<div><{'ul' if d % 2 == k else 'ol'}></{'ul' if d % 2 == k else 'ol'}><p>{k}" for d in range(50))
    own = wrapper._page_wrapper(wrapper.parse(page(0)))
    for k in (1, 0, 1):
        own = wrapper.merged(own, wrapper._page_wrapper(wrapper.parse(page(k))))
    depth, node = 0, own
    while node[wrapper._CHILDREN]:
        node, depth = next((c for c in node[wrapper._CHILDREN] if c[0] == "div"), node[wrapper._CHILDREN][-1]), depth + 1
    assert depth >= 50


@pytest.mark.parametrize("sent", [1 << 30, 0])
def test_wrappers_drop_what_a_host_repeats(spark, monkeypatch, sent):
    monkeypatch.setattr(wrapper, "SENT_BYTES", sent)
    rows = [(i, f"http://Same.example/{i}", PAGE.format(i)) for i in range(12)]
    rows += [(20 + i, "https://few.example:80/?q", PAGE.format(1)) for i in range(9)]
    rows += [(40, None, PAGE.format(3)), (41, "http://x/", None), (42, "", ""), (None, "http://x/", "<p>n</p>")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i] == f"Head {i} One {i} & two Threefour five {i}"
    assert got[20] == "Head 1 One 1 & two Threefour five 1 Always the same line"
    assert (got[40], got[41], got[42], got[None]) == (wrapper.extract(PAGE.format(3)), "", "", "n")
    assert wrapper.main_texts(df.where("false")).count() == 0


def test_constant_siblings_of_one_label_are_template(spark):
    """Paragraphs and divs without classes: what a host repeats goes, whatever the number of its siblings."""
    story = lambda i: "".join(f"<p>Line {k} of {i}</p>" for k in range(1 + i % 4))
    inside = lambda i: f"<article><h1>Head {i}</h1>{story(i)}<p>Read <a href=x>our terms</a></p></article>"
    around = lambda i: f"<body><div>Home</div>{'<div>Extra %d</div>' % i if i % 3 == 0 else ''}<div id=c{i}>{story(i)}</div><div><p>All rights kept</p></div>"
    rows = [(i, "http://a.example/", inside(i)) for i in range(12)] + [(100 + i, "http://b.example/", around(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(df).collect()}
    for i in range(12):
        lines = " ".join(f"Line {k} of {i}" for k in range(1 + i % 4))
        assert got[i] == f"Head {i} {lines}"
        assert got[100 + i] == (f"Extra {i} " if i % 3 == 0 else "") + lines
    own = wrapper._page_wrapper(wrapper.parse(inside(3)))
    for i in range(200):
        own = wrapper.merged(own, wrapper._page_wrapper(wrapper.parse(inside(i))))
    article = own[wrapper._CHILDREN][0]
    assert [c[wrapper._LABEL] for c in article[wrapper._CHILDREN]] == ["h1", "p", "p"]


def test_alignment_goes_before_names(spark):
    """Constant blocks go whatever they are called, an article in an element named as furniture stays, comments never do."""
    hull = lambda i: f"<body><div class=x>Welcome to us</div><form id=aspnet><h1>Head {i}</h1><p>{'story %d ' % i * 30}<p>Words {i * 7}</form><div class=y>Made with care</div>"
    talk = lambda i: f"<article><p>Short {i}</p></article><div class=comments><p>{'chatter %d ' % i * 300}</div><aside>see {i}</aside>"
    rows = [(i, "http://a.example/", hull(i)) for i in range(9)] + [(100 + i, "http://b.example/", talk(i)) for i in range(9)] + [(200 + i, f"http://c{i}.example/", hull(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(df).collect()}
    for i in range(9):
        assert got[i] == " ".join(f"Head {i} {'story %d ' % i * 30} Words {i * 7}".split())
        assert got[100 + i] == f"Short {i}"
    for i in range(3):
        assert got[200 + i] == "Welcome to us Made with care"


def test_the_content_region_needs_no_names(spark):
    """Everything varies and nothing is named: the wrapper's region alone tells the article; without it all would be kept."""
    page = lambda i: f"<body><ul><li>go {i}<li>back {i * 3}</ul><div class=q>buy {i}</div><div class=z><h1>Head {i}</h1><p>{'story %d ' % i * 40}</div><div class=k>seen {i} times</div>"
    rows = [(i, "http://a.example/", page(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(9):
        assert got[i] == " ".join(f"Head {i} {'story %d ' % i * 40}".split())
        assert wrapper.extract(page(i)).startswith(f"go {i} back {i * 3} buy {i} Head {i}")


def test_very_long_pages(spark):
    page = lambda i: f"<nav>menu</nav><article>{''.join(f'<p>Line {k} of {i}</p>' for k in range(20_000))}<p>Bye</p></article>"
    rows = [(i, "http://a.example/", page(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {i: " ".join(f"Line {k} of {i}" for k in range(20_000)) for i in range(6)}


@pytest.mark.parametrize("sent", [1 << 30, 0])
@pytest.mark.parametrize("depth", [130, 4000])
def test_wrappers_reach_every_depth(spark, monkeypatch, depth, sent):
    monkeypatch.setattr(wrapper, "SENT_BYTES", sent)
    page = lambda i: "<div>" * depth + f"<p>Story {i}</p><p>Call us at any time</p>" + "</div>" * depth
    # Each level differs by a sibling, so every level is matched by the full rule.
    mixed = lambda i: "".join("<div>" + "<ul>x</ul>" * (d % 2 == i % 2) for d in range(depth)) + f"<p>Story {i}</p><p>Call us at any time</p>"
    rows = [(i, "http://a.example/", page(i)) for i in range(9)] + [(100 + i, "http://b.example/", mixed(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(9):
        assert got[i] == f"Story {i}"
    for i in range(12):
        assert got[100 + i] == f"Story {i}"


def tree_size(a, b):
    """Simple tree matching as it is defined."""
    size = 1 + wrapper.EQUAL if a[1] and a[1] == b[1] else 1
    return size + siblings_size(a[3], b[3])


def siblings_size(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        both = best[i, j] + tree_size(a[i], b[j]) if a[i][0] == b[j][0] else 0
        best[i + 1, j + 1] = max(both, best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("pairs", [1, 6, 50])
def test_matches_of_many_siblings_are_largest(monkeypatch, pairs):
    monkeypatch.setattr(wrapper, "MATCHED", pairs)
    rng = np.random.default_rng(11)

    def tree(depth):
        children = [tree(depth - 1) for _ in range(rng.integers(0, 5))] if depth else []
        return [str(rng.choice(["p", "li", "div"])), rng.choice(["", None, "a", "b", "c", "d"]), False, children, [], 0, 1]

    for k in range(120):
        a, b = ([tree(k % 3) for _ in range(rng.integers(0, 14))] for _ in range(2))
        if k % 4 == 0:
            b = a[:2] + b + a[3:]
        if k % 4 == 1:
            a = [tree(int(rng.random() < 0.1)) for _ in range(60)]
            b = b[:5]
        if k % 8 == 1:
            a, b = b, a
        got = wrapper.matched(a, b)
        assert all(i < k and j < l for (i, j), (k, l) in itertools.pairwise(got))
        assert all(a[i][0] == b[j][0] for i, j in got)
        assert sum(tree_size(a[i], b[j]) for i, j in got) == siblings_size(a, b)


def test_a_host_repeats_many_siblings(spark):
    """Four hundred constant paragraphs that some pages of a host lack are template, all of them."""
    rules = lambda i: "".join(f"<p>Rule {k}</p>" for k in range(400 if i % 3 else 1))
    rows = [(i, "http://a.example/", f"<body><article><h1>Head {i}</h1><section>Story {i}</section>{rules(i)}</article>") for i in range(12)]
    # More pairs than one table takes, each page without other ones.
    links = lambda i: "".join(f"<li><a>Link {k}</a>" for k in range(300) if (k + 2 * i) % 14)
    rows += [(100 + i, "http://b.example/", f"<body><article><h1>Head {i}</h1><section>Story {i}</section><ol>{links(i)}</ol></article>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: f"Head {k % 100} Story {k % 100}" for k in [*range(12), *range(100, 140)]}


def test_rolling_lists_fold_to_one_order(monkeypatch):
    """Wrappers that grow with their pages are the same whether pages are folded one by one or together first."""
    pages = [wrapper._page_wrapper(wrapper.parse(f"<h1>Head {i}</h1><ul>{''.join(f'<li>Item {k}' for k in range(i, i + 5))}</ul>")) for i in range(60)]
    whole = []
    for folded in (1, 8, 1 << 30):
        monkeypatch.setattr(wrapper, "FOLDED", folded)
        folds = wrapper.Folds()
        for page in pages:
            folds.add(wrapper._unpacked(wrapper._packed(page)))
        whole.append(wrapper._packed(folds.whole()))
    assert whole[0] == whole[1] == whole[2]
    own = wrapper._unpacked(whole[0])
    assert [c[wrapper._TEXT] for c in own[wrapper._CHILDREN][1][wrapper._CHILDREN]] == [wrapper._digest(f"Item {k}") for k in range(64)]
    assert wrapper.extract("<h1>Head 7</h1><ul><li>Item 30<li>Item 99</ul>", own) == "Head 7 Item 99"
