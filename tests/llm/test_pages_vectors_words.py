"""Generated pages with known text, and edges of vectors and words."""

import random
import time

from pyspark.sql import functions as F

from tessellex.llm import html_text, language, vector_dedup

PAGES = "page_id bigint, url string, html string, text string, size string"
NAV = '<nav><a href=/>Home</a></nav><div class="cookie-banner">We use cookies.</div>'
FOOT = '<div class="site-footer"><a href=/t>Terms</a></div><footer>Someone 2020</footer>'


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words)).capitalize() + "."


def body(rng):
    """Blocks of an article and their text: paragraphs, headings and named pieces that are content, and furniture that isn't."""
    blocks, kept = [], []
    for _ in range(rng.randint(3, 7)):
        kind = rng.choice(["p", "p", "p", "named p", "heading", "named section", "links", "advert", "list"])
        words = prose(rng, rng.randint(40, 90))
        if kind == "p":
            blocks.append(f"<p>{words}</p>")
        elif kind == "named p":
            blocks.append(f'<p class="share-price">{words}</p>')
        elif kind == "heading":
            words = prose(rng, 4)
            blocks.append(f'<h2 id="{rng.choice(["side-effects", "legal-notice", "search"])}">{words}</h2>')
        elif kind == "named section":
            blocks.append(f'<section id="search-results"><p>{words}</p></section>')
        elif kind == "links":
            blocks.append('<div class="share-this-now"><a href=a>Tweet</a> <a href=b>Mail</a></div>')
            continue
        elif kind == "advert":
            blocks.append('<div class="ad-box">Buy things now</div>')
            continue
        else:
            items = [prose(rng, 6) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            kept += items
            continue
        kept.append(words)
    first, last = prose(rng, 80), prose(rng, 80)
    return [f"<p>{first}</p>", *blocks, f"<p>{last}</p>"], [first, *kept, last]


def page(rng):
    blocks, kept = body(rng)
    inside = "".join(blocks)
    shape = rng.choice(["article", "main", "two", "short second", "wrapper", "div", "headline"])
    if shape == "article":
        return f"<body>{NAV}<article><header><h1>Top</h1><p>Deck.</p><ul><li>tag</li></ul></header>{inside}</article>{FOOT}", ["Top", "Deck.", *kept]
    if shape == "main":
        return f"<body>{NAV}<main>{inside}</main>{FOOT}</body>", kept
    if shape == "two":
        more, text = body(rng)
        return f"<body>{NAV}<article>{inside}</article><article>{''.join(more)}</article>{FOOT}", kept + text
    if shape == "short second":
        return f"<body>{NAV}<article>{inside}</article><article><p>In brief.</p></article>{FOOT}", [*kept, "In brief."]
    if shape == "wrapper":
        return f'<body>{NAV}<div class="layout has-sidebar"><article>{inside}</article><div class="sidebar">x</div></div>{FOOT}', kept
    if shape == "div":
        return f"<body>{NAV}<div id=text>{inside}</div>{FOOT}</body>", kept
    return f"<body>{NAV}<h1>Top</h1><div id=text>{inside}</div>{FOOT}</body>", ["Top", *kept]


def test_generated_pages_give_their_text():
    for seed in range(400):
        html, kept = page(random.Random(seed))
        assert html_text.main_text(html) == "\n".join(kept), seed


def test_pages_without_an_article_lose_links_and_rights():
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    links = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
    html = f"<body>{links}<p>{a}</p><p>Short.</p><p>{b}</p><p>The end.</p><p>All rights reserved 2020</p></body>"
    assert html_text.main_text(html) == f"{a}\nShort.\n{b}\nThe end."
    assert html_text.main_text(f"<article><p>{a}</p><noscript><img src=x><p>{b}</p></article>") == f"{a}\n{b}"
    assert html_text.main_text(f"<article><p>{a}</p><noscript><p>{b}</p></noscript></article>") == a


def test_deep_and_long_pages_take_linear_time():
    words = prose(random.Random(3), 50)
    start = time.perf_counter()
    assert html_text.main_text("<div>" * 20_000 + words) == words
    assert html_text.main_text("<a><b><div class='share-price'>w</p></span>" * 5_000).count("w") in (0, 5_000)
    assert time.perf_counter() - start < 5


def test_pages_table(spark):
    a = prose(random.Random(4), 50)
    html = f"<article><p>{a}</p></article>"
    rows = [(1, "u", html, "t", "s"), (1, "u", html, "t", "s"), (2, None, None, None, None), (None, "v", "", "t", "s"), (3, "w", html * 3_000, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted([(1, "u", a), (1, "u", a), (2, None, ""), (None, "v", ""), (3, "w", "\n".join([a] * 3_000))], key=str)
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_vectors_of_extreme_magnitude(spark):
    rows = [(1, [1e200] * 4, 1, "x"), (2, [2e200] * 4, 1, "x"), (3, [1e-200] * 4, 1, "x"), (4, [1e-200, -1e-200] * 2, 1, "x"), (5, [5e-324, 0.0], 1, "x"),
            (6, [1.0, 0.0], 1, "x"), (6, [1.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, size string")
    found = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert found == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 2, 5), (6, 2, 5)}
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_words_are_letters_with_marks(spark):
    assert language.words_of("½ ² 12 _ x² Ⅷ") == ["x"]
    assert language.words_of("हिन्दी है") == ["हिन्दी", "है"]
    rows = [(i, "the house is here" if i % 2 else "das haus ist hier", "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(50, "½ ²", None, "s"), (51, "the house " * 3_000, None, "s"), (None, "das haus", "de", None), (1, rows[1][1], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = language.train(df, max_docs=5)
    found = [(r["doc_id"], r["lang_pred"]) for r in language.identify(df, model).collect()]
    assert sorted(found, key=str) == sorted([(i, "und" if t[0] == "½" else "en" if "house" in t else "de") for i, t, *_ in rows], key=str)
    assert language.identify(df.where(F.lit(False)), language.train(df.where(F.lit(False)))).count() == 0
