import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from dyadspark.llm.main_text import STOP_WORDS, Block, blocks, first_pass, main_text, op2_main_text, second_pass
from tests.llm.helpers import save

TEXT = "The quick brown fox is in the garden of the house and it was not there for a long time."
CASES = {
    "frame": (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy this now</div><article><h1>Title &amp; more</h1><p>{TEXT}</p></article><aside>Related</aside><footer>&copy; x</footer>", f"Title & more\n{TEXT}"),
    "white space and references": ("<article><p> a\n\t b&nbsp;&#x41;<br>c </p><p>&lt;p&gt;</p></article>", "a b A c\n<p>"),
    "raw content": ('<article><p>one</p><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> --><p>two</p><noscript>no</noscript></article>', "one\ntwo"),
    "forms and comments": (f"<main><p>{TEXT}</p><form><label>Name</label><input></form><section id=comments><p>{TEXT} I agree</p></section></main>", TEXT),
    "unclosed tags": ("<article><p>one<p>two<b>bold</b><ul><li>three<li>four</ul>", "one\ntwobold\nthree\nfour"),
    "no article": (f'<div id=menu><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><div class="post has-sidebar"><p>{TEXT} {TEXT} {TEXT}</p><p>Short.</p><p>{TEXT} {TEXT}</p></div><div class=cookie-notice>{TEXT}</div>', f"Head\n{TEXT} {TEXT} {TEXT}\nShort.\n{TEXT} {TEXT}"),
    "article header": (f"<header>Site</header><article><header class=entry-header><h1>Own title</h1></header><p>{TEXT}</p></article>", f"Own title\n{TEXT}"),
    "class of the page": (f'<body class="has-sidebar no-nav"><article><p>{TEXT}</p></article></body>', TEXT),
    "nothing": ("<nav><a href=/>x</a></nav>", ""),
    "stray marks": ("<article><p>a < b and c > d</p><p>5 <6</p></article>", "a < b and c > d\n5 <6"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert main_text(html) == want


@pytest.mark.parametrize("name", ["post hentry category-news tag-economy", "tag-search category-social", "share-price", "social-sciences", "search-results"])
def test_classes_that_name_a_topic_keep_the_text(name):
    assert main_text(f'<div class="{name}"><p>{TEXT} {TEXT} {TEXT}</p></div>') == f"{TEXT} {TEXT} {TEXT}"


@pytest.mark.parametrize("name", ["tags", "post-tags", "tag-cloud", "tags-links", "entry-share", "social-share-buttons", "search-form", "searchbox", "category-menu"])
def test_classes_of_lists_and_buttons_mark_boilerplate(name):
    assert main_text(f'<p>{TEXT} {TEXT} {TEXT} {TEXT}</p><div class="{name}"><p>{TEXT} {TEXT} {TEXT}</p></div>') == f"{TEXT} {TEXT} {TEXT} {TEXT}"


def oracle_first(found):
    """The rules of pass one, written down once more, block by block."""
    free = [b for b in found if b.framed != 2 and b.linked * 2 <= len(b.text)]
    words = [w for b in free for w in re.findall(r"[^\W\d_]+", b.text.lower())]
    listed = 10 * sum(w in STOP_WORDS for w in words) >= max(1, len(words))
    in_article = sum(len(b.text) for b in free if b.in_article)
    out = []
    for b in found:
        own = re.findall(r"[^\W\d_]+", b.text.lower())
        density, n, share = sum(w in STOP_WORDS for w in own) / max(1, len(own)), len(b.text), b.linked / len(b.text)
        label = None
        if share > 0.9 or b.framed == 2:
            label = False
        elif share > 0.5 and not (b.in_article and n >= 70 and density >= 0.15):
            label = False
        elif b.heading:
            label = None
        elif not b.in_article and in_article > sum(len(x.text) for x in free) / 2:
            label = False
        elif share <= 0.5 and not listed and n >= 70 and re.search(r"[.!?](\s|$)", b.text):
            label = True
        elif n < 70:
            if b.framed or (not b.in_article and (b.linked or "\u00a9" in b.text)):
                label = False
        elif share <= 0.5 and listed and (density >= 0.3 or (density >= 0.15 and n >= 200)):
            label = True
        elif b.framed or (listed and density < 0.15 and b.linked and not b.in_article):
            label = False
        out.append(label)
    return out


def oracle_second(found, labels):
    """Pass two by looking at every other block."""
    if not any(labels):
        open_ = [b for b, label in zip(found, labels, strict=True) if label is None]
        return [label is None and not all(b.heading for b in open_) for label in labels]
    out = []
    for k, label in enumerate(labels):
        if label is None:
            seen = [(abs(j - k), not labels[j], j > k, labels[j]) for j in range(len(labels)) if labels[j] is not None and (found[j].in_article or not found[k].in_article)]
            later = [x for x in seen if x[2]]
            label = min(later)[3] if found[k].heading and later else min(seen)[3] if seen else found[k].in_article
        out.append(label)
    return out


def test_both_passes_are_those_of_an_oracle():
    rng = random.Random(5)
    vocabulary = {"en": "the of and to in house garden river stone over blue seven walking".split(), "none": "kala mita suuri vene talo järvi metsä lumi".split()}
    rules = Counter()
    for _ in range(3000):
        words = vocabulary[rng.choice(["en", "en", "none"])]
        found = []
        for _ in range(rng.randint(0, 12)):
            text = " ".join(rng.choices(words[rng.choice((0, 4)) :], k=rng.choice((1, 3, 12, 20, 60)))) + rng.choice(("", ".", " \u00a9"))
            found.append(Block(text, int(len(text) * rng.choice((0, 0, 0, 0.3, 0.7, 1))), rng.choice((0, 0, 0, 0, 1, 2)), rng.random() < 0.4, rng.random() < 0.15))
        labels = first_pass(found)
        rules.update(rule for _, rule in labels)
        assert [label for label, _ in labels] == oracle_first(found)
        assert second_pass(found, [label for label, _ in labels]) == oracle_second(found, [label for label, _ in labels])
    assert min(rules[r] for r in ("tag", "links", "density", "length", "short", "ambiguous", "heading")) > 100


def test_most_blocks_of_whole_pages_are_decided_by_density_links_and_neighbours(spark):
    rules = Counter()
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").toLocalIterator():
        rules.update(rule for _, rule in first_pass(blocks(row["html"])))
    assert min(rules["density"], rules["links"], rules["short"]) > 100 and rules["length"] and rules["tag"] < sum(rules.values()) / 4


RUSSIAN = "Вчера вечером состоялось заседание совета компании. Решение было принято единогласно всеми её участниками."
JAPANESE = "東京は日本の首都であり、世界最大級の都市圏を形成している。人口は約千四百万人である。"
FINNISH = "Eilen illalla pidettiin yhtiön hallituksen kokous. Päätös tehtiin yksimielisesti kaikkien osallistujien kesken."
NEW_CASES = {
    "one short paragraph": ("<p>Hello world.</p>", "Hello world."),
    "heading and one short paragraph": ("<nav><a href=/>Home</a></nav><h1>Title</h1><p>Short.</p><footer>x</footer>", "Title\nShort."),
    "only a heading": ("<nav><a href=/>Home</a></nav><h1>Title</h1>", ""),
    "russian": (f"<ul><li><a href=1>Дом</a></ul><div><h1>Новости</h1><p>{RUSSIAN}</p></div>", f"Новости\n{RUSSIAN}"),
    "japanese": (f"<ul><li><a href=1>ホーム</a></ul><div><p>{JAPANESE}</p><p>{JAPANESE}</p></div>", f"{JAPANESE}\n{JAPANESE}"),
    "no list of stop words": (f"<div><p>{FINNISH}</p><p>Lyhyt.</p><p>{FINNISH}</p></div>", f"{FINNISH}\nLyhyt.\n{FINNISH}"),
    "notice within an article": (f'<article><p>{TEXT}</p><div class="notice"><p>{TEXT} {TEXT}</p></div><div class="notice">Saved.</div></article>', f"{TEXT}\n{TEXT} {TEXT}"),
    "recommendation within an article": (f'<article><p>{TEXT}</p><p class="recommendation">{TEXT}</p></article>', f"{TEXT}\n{TEXT}"),
    "comments within an article": (f'<article><p>{TEXT}</p><div class="comments"><p>{TEXT} {TEXT}</p></div></article>', TEXT),
    "comments as articles": (f'<main><p>{TEXT}</p></main><article class="comment"><p>{TEXT} {TEXT}</p></article>', TEXT),
    "paragraph mostly link": (f"<article><p>{TEXT}</p><p>It was <a href=1>in the house of the old man and it was not there for long</a> as they say.</p></article>", f"{TEXT}\nIt was in the house of the old man and it was not there for long as they say."),
    "list of links in an article": (f"<article><p>{TEXT}</p><ul><li><a href=1>One more of the stories</a></ul></article>", TEXT),
    "text beside an article": (f"<div>{TEXT}</div><article><p>{TEXT} {TEXT}</p></article>", f"{TEXT} {TEXT}"),
    "wrapper with the page's text": (f'<div class="widget-area"><article><p>{TEXT}</p></article></div>', TEXT),
    "form around the page": (f"<form><div><p>{TEXT}</p></div></form>", TEXT),
    "sidebar with much text": (f'<article><p>{TEXT}</p></article><div class="sidebar"><p>{TEXT} {TEXT} {TEXT}</p></div>', TEXT),
    "short items at an article's end": (f"<article><p>{TEXT}</p><p>One</p><p>Two</p><p>Three</p></article><footer>a</footer><footer>b</footer>", f"{TEXT}\nOne\nTwo\nThree"),
    "low density in an article": ("<article><p>alpha beta gamma " + "kilo lima mike " * 30 + f"</p><p>{TEXT}</p></article>", "alpha beta gamma " + ("kilo lima mike " * 30).strip() + f"\n{TEXT}"),
}


@pytest.mark.parametrize("name", NEW_CASES)
def test_pages_decided_by_their_blocks(name):
    html, want = NEW_CASES[name]
    assert main_text(html) == want


def test_query(spark, tmp_path):
    rows = [(1, "u", CASES["frame"][0]), (1, "u", CASES["frame"][0]), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "long é " * 100_000)]
    pages = pa.Table.from_pylist([{"page_id": i, "url": u, "html": h, "text": "old", "n_chars": 7} for i, u, h in rows])
    got = op2_main_text(spark, save(tmp_path, pages=pages)).collect()
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=repr) == sorted(((i, u, main_text(h)) for i, u, h in rows), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and max(r["n_chars"] for r in got) == 699_999


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 20_000 + "x") == "x"
    assert main_text("<div class=widget>" * 20_000 + "x") == "x"
    assert main_text("<article><p " + "a='" * 5000 + ">x</p>") is not None
    assert main_text("<article><p>kept</p>" + "<i" * 5000) .startswith("kept")


def test_empty_table(spark, tmp_path):
    pages = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())})
    assert op2_main_text(spark, save(tmp_path, pages=pages)).collect() == []
