import numpy as np
import pytest

from helixmill.llm import html_text

PROSE = "It is the story of a man and the sea, and of all that was in it when he had left the land."
MORE = "There was no wind on that day, and the boat was so still that he could see the bottom of the bay."
LINKS = "<ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul>"

WRAPPED = {
    "a form round the page": f"<body><form id=aspnetForm><article><p>{PROSE}</p></article></form>",
    "one of several names": f"<article class='post share'><p>{PROSE}</p></article>",
    "a widget round the article": f"<div class='widget'><article><p>{PROSE}</p></article></div>",
    "an open menu": f"<nav>{LINKS}<article><p>{PROSE}</p></article>",
    "a form without an article": f"<form id=aspnetForm><div class=menu>{LINKS}</div><div><p>{PROSE}</p></div></form>",
    "an open menu without an article": f"<nav>{LINKS}<div><p>{PROSE}</p></div>",
    "an overlay round main": f"<div class=overlay><main><p>{PROSE}</p></main></div>",
    "reader comments": f"<article><p>{PROSE}</p><div class=reader-comments><p>{MORE}</p></div></article>",
    "an advert by its size": f"<article><p>{PROSE}</p><div class=ad-300x250><p>{MORE}</p></div></article>",
    "a footer by its name": f"<article><p>{PROSE}</p><div class=article-footer><p>{MORE}</p></div></article>",
    "comments that are articles": f"<article><p>{PROSE}</p><section id=comments><article><p>{MORE}</p></article></section></article>",
    "an article that is a comment": f"<article><p>{PROSE}</p></article><article class='comment even depth-1'><p>{MORE}</p></article>",
    "a notice that is long": f"<div class=cookie-notice><p>{MORE} {MORE}</p></div><div><p>{PROSE}</p></div>",
    "a form that is the smaller part": f"<form><p>{MORE}</p></form><div><p>{PROSE}</p><p>{PROSE[:-1]}; so he said.</p></div>",
}


@pytest.mark.parametrize("case", WRAPPED)
def test_articles_survive_what_is_round_them(case):
    text = html_text.main_text(WRAPPED[case])
    assert text.startswith(PROSE[:-1]) and MORE not in text and "Home" not in text


def test_names():
    for name in "comments reader-comments ad-300x250 article-footer post-ads advert_970x250 commentList".split():
        assert html_text._grade_of_name(name) == html_text._ALL, name
    for name in "has-comments with-sidebar share-of-market adventure content add-on no-footer page-header-image".split():
        assert html_text._grade_of_name(name) == 0, name


#: Class names with the grade that they give an element other than an article.
_CLASSES = {"": 0, "comments": 3, "reader-comments": 3, "ad-300x250": 3, "article-footer": 3, "cookie-notice": 2, "sidebar": 2, "widget": 1, "post share": 1, "nav": 1, "has-comments": 0, "content": 0, "share-of-market": 0}
_GRADES = {"aside": 3, "footer": 3, "form": 1, "nav": 1, "header": 1}
_PLAIN = ("div", "section", "p", "span", "b", "article", "main", "ul", "h2")
_INLINE = ("span", "b")


def _tree(rng, depth, words):
    kids = []
    for _ in range(int(rng.integers(1, 4))):
        if depth and rng.random() < 0.65:
            kids.append(_tree(rng, depth - 1, words))
        else:
            kids.append(f"w{next(words)} " + [PROSE, MORE, "Short words", "x"][int(rng.integers(0, 4))])
    tag = str(rng.choice([*_PLAIN, *_GRADES] if rng.random() < 0.4 else _PLAIN[:5]))
    if tag in ("p", *_INLINE) and any(isinstance(k, tuple) for k in kids):
        tag = "div"
    return tag, "" if tag in _INLINE else str(rng.choice(list(_CLASSES))) if rng.random() < 0.3 else "", kids


def _html(node):
    if isinstance(node, str):
        return node
    tag, name, kids = node
    return f"<{tag}" + (f' class="{name}"' if name else "") + ">" + " ".join(map(_html, kids)) + f"</{tag}>"


def _walked(root):
    """Blocks of a tree as [text, path of elements], cut where an element that is no inline one begins or ends."""
    blocks, text = [], []

    def cut(path):
        if joined := " ".join(" ".join(text).split()):
            blocks.append([joined, path])
        text.clear()

    def walk(node, path):
        if isinstance(node, str):
            text.append(node)
            return
        inline = node[0] in _INLINE
        if not inline:
            cut(path)
        own = [*path, node]
        for kid in node[2]:
            walk(kid, own)
        if not inline:
            cut(own)

    walk(root, [])
    return blocks


def _expected(blocks):
    """(text, boilerplate) of each block, asking every element round it."""
    def grade(node, path):
        tag, name, _ = node
        if tag in _GRADES:
            return 0 if tag == "header" and any(p[0] in ("article", "main") for p in path) else _GRADES[tag]
        if tag == "main" or not name:
            return 0
        if tag == "article":
            return 3 if _CLASSES[name] and name != "post share" else 0
        return _CLASSES[name]

    def marks(path):
        """Grades that hold for a block: all of 3, others behind the last container; parts by identity."""
        every, parts, outside = False, [], False
        for i, node in enumerate(path):
            if node[0] in ("article", "main"):
                parts, outside = [], False
            g = grade(node, path[:i])
            every, outside = every or g == 3, outside or g == 2
            if g == 1:
                parts.append(id(node))
        return every or outside, parts

    found = [(text, *marks(path)) for text, path in blocks]
    def stops(text):
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        n = sum(w in html_text.STOP_WORDS for w in words)
        return n if len(words) >= 10 and n >= 0.2 * len(words) else 0

    weight = [0 if bad else stops(text) for text, bad, _ in found]
    assert any(weight) or all(bad or len(text.split()) < 10 for text, bad, _ in found)
    total = sum(weight)
    held = {}
    for w, (_, _, parts) in zip(weight, found):
        for p in parts:
            held[p] = held.get(p, 0) + w
    return [(text, bad or any(2 * held[p] <= total for p in parts)) for text, bad, parts in found]


def test_blocks_against_a_tree_walk():
    rng = np.random.default_rng(21)
    kinds = set()
    for _ in range(1500):
        tree = ("body", "", [_tree(rng, 5, iter(range(1000)))])
        want = _expected(_walked(tree))
        got = [(b.text, b.boilerplate) for b in html_text.blocks_of(_html(tree))]
        assert got == want, _html(tree)
        kinds |= {bad for _, bad in want}
    assert kinds == {True, False}
