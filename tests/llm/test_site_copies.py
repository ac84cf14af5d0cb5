"""The style tree against a brute-force one; copies, roles and hostile markup."""

import math
import random
from collections import Counter

import pytest

from spanloom.llm import site_style


def article(n):
    body = "".join(f"<p>Paragraph {k} of article {n} tells what happened there.</p>" for k in range(10))
    return f"<html><body><nav><a href='/'>Home</a></nav><div class='article'><h1>Title {n}</h1>{body}</div></body></html>"


@pytest.mark.parametrize("copies", [30, 1000])
def test_copies_keep_their_text(spark, copies):
    rows = [(k, f"https://www.one.org/copy/{k}", article(0)) for k in range(copies)] + [(5000, "https://www.one.org/other", article(1))]
    found = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for key, n in ((0, 0), (copies - 1, 0), (5000, 1)):
        assert f"Title {n}" in found[key] and all(f"Paragraph {k} of article {n}" in found[key] for k in range(10))


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


@pytest.mark.parametrize(
    "body",
    [
        "<body class='home no-sidebar'><article><p>Told once, {k}.</p></article></body>",
        "<body class='hfeed has-sidebar'><main><p>Told once, {k}.</p></main></body>",
        "<body><article class='post has-comments'><p>Told once, {k}.</p></article></body>",
        "<body><article><p class='text-side note'>Told once, {k}.</p></article></body>",
        "<body><div class='content sidebar-left'><p>Told once, {k}.</p></div></body>",
        "<body><!-- <article> --><script>'<main>'</script><p>Told once, {k}.</p></body>",
    ],
)
def test_class_tokens_do_not_empty_pages(spark, body):
    for size in (1, 12):
        found = extracted(spark, [(k, "http://a.org/", f"<html>{body.replace('{k}', str(k))}</html>") for k in range(size)])
        assert found == {k: f"Told once, {k}." for k in range(size)}


def test_text_of_formulas_and_drawings_stays(spark):
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><svg><text>axis</text></svg></article>"
    assert extracted(spark, [(1, "http://a.org/", page)]) == {1: "Let x=2 be.\naxis"}


def test_deep_markup_is_linear(spark):
    page = "<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "<p>shallow</article>"
    assert extracted(spark, [(1, "http://a.org/", page)]) == {1: "deep\nshallow"}


def brute_low(pages):
    """Low nodes of one host: pages are trees (tag, class, text, children), nodes are paths of (tag, class)."""
    contents, styles, size, ups = {}, {}, Counter(), {}

    def walk(tree, path):
        tag, kind, text, children = tree
        path = (*path, (tag, kind))
        if text:
            contents.setdefault(path, []).append(text)
            size[path] += len(text)
        labels = [c[:2] for c in children]
        styles.setdefault(path, []).append(tuple(x for k, x in enumerate(labels) if not k or labels[k - 1] != x))
        for c in children:
            walk(c, path)

    for tree in pages:
        walk(tree, ())

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else max(0.0, -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(m))

    worth = {}
    for path, texts in contents.items():
        m = len(texts)
        evidence = max(entropy(texts), 0.5 * entropy(styles[path]))
        worth[path] = 1 - m / (m + 10) * (1 - evidence)
    for path in worth:
        for n in range(1, len(path) + 1):
            ups.setdefault(path[:n], []).append(path)
    low = set()
    for top, below in ups.items():
        inside = any(t == "article" for t, _ in top)
        beside = not any(t == "article" for path in below for t, _ in path)
        side = top[-1][1] in ("ad", "comments") and 2 * sum(size[b] for b in below) < sum(size.values())
        if max(worth[b] for b in below) * (0.25 if side or beside else 1) < (0.3 if inside else 0.5):
            low.add(top)
    return low


def written(tree):
    tag, kind, text, children = tree
    return f"<{tag}{f' class={kind}' if kind else ''}>{text}{''.join(map(written, children))}</{tag}>"


def brute_text(tree, low, path=()):
    path = (*path, tree[:2])
    if path in low:
        return []
    return ([tree[2]] if tree[2] else []) + [t for c in tree[3] for t in brute_text(c, low, path)]


@pytest.mark.parametrize("few", [100_000, 0])  # 0: low nodes are joined, not sent
def test_tree_as_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(site_style, "FEW", few)
    rng = random.Random(21)
    rows, expected, removed, by_evidence = [], {}, 0, 0
    for host in range(16):
        notices = [f"notice {host} {n}" for n in range(rng.choice((1, 1, 4)))]
        trees = []
        for k in range(rng.choice((1, 3, 15, 40))):
            fresh = lambda k=k: f"told {host} {k} {rng.random()}"
            parts = [("div", "", fresh(), []) for _ in range(rng.randint(1, 3))]
            parts += [("div", "box", rng.choice(notices), [("div", "", rng.choice(notices), [])]), ("section", "comments", "", [("div", "", fresh(), [])])]
            rng.shuffle(parts)
            around = [("div", "ad", rng.choice(notices), []), ("section", "tail", rng.choice(notices), [("div", "", rng.choice((fresh(), notices[0])), [])])]
            trees.append(("body", "", "", [around[0], ("article", "", "", parts), *around[1:]]))
        low = brute_low(trees)
        by_evidence += any(path[-1] == ("div", "box") for path in low)
        for k, tree in enumerate(trees):
            rows.append((len(rows), f"http://h{host}.org/{k}", written(tree)))
            expected[rows[-1][0]] = "\n".join(brute_text(tree, low))
            removed += expected[rows[-1][0]] != "\n".join(brute_text(tree, set()))
    assert extracted(spark, rows) == expected and removed == len(rows) and by_evidence
