"""Hand-labelled page layouts for the extraction of main text."""

import os
import random
import time

import pytest

from brindle.llm import html_text


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["people", "had", "the", "water", "of", "was", "évening", "two"]) for _ in range(n))


A, B, C, D = (prose(i, 45) for i in range(4))
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>"
LINKS = "<div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>"
FOOT = "<footer><p>&copy; 2020 Some House</p></footer>"
LAYOUTS = {
    "article": (f"<body>{NAV}<article><h1>T</h1><p>{A}</p><p>Tiny.</p></article>{FOOT}", f"T\n{A}\nTiny."),
    "main": (f"<body>{NAV}<main><h1>T</h1><p>{A}</p></main>{FOOT}", f"T\n{A}"),
    "div soup": (f"<body>{LINKS}<div><h2>T</h2><p>{A}</p><p>{B}</p></div><div>Contact us</div>", f"T\n{A}\n{B}"),
    "paragraphs in the body": (f"<body>{LINKS}<div><a href=1>a</a></div><div><a href=2>b</a></div><div><a href=3>c</a></div><h1>T</h1><p>{A}</p><p>{B}</p><div><a href=4>d</a></div><div><a href=5>e</a></div><div><a href=6>f</a></div><div><a href=7>g</a></div>", f"T\n{A}\n{B}"),
    "form around the page": (f"<body><form id=aspnet>{NAV}<div><p>{A}</p><p>{B}</p></div>{FOOT}</form>", f"{A}\n{B}"),
    "form around an article": (f"<body><form><article><p>{A}</p></article></form>", A),
    "form inside": (f"<body><article><p>{A}</p><form><label>Name</label><input><p>We never send your name to others</p></form><p>{B}</p></article>", f"{A}\n{B}"),
    "header inside the article": (f"<body><header><h1>Site</h1></header><article><header><h1>Own title</h1><a href=x>tag</a></header><p>{A}</p></article>", f"Own title\n{A}"),
    "header of the page": (f"<body><header><h1>Site</h1><p>Motto</p></header><div><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}"),
    "entry-header": (f"<body><div class=post><div class=entry-header><h1>T</h1></div><p>{A}</p><p>{B}</p></div>", f"T\n{A}\n{B}"),
    "related prose": (f"<body><article><p>{A}</p><section class=related-work><p>{B}</p></section></article>", f"{A}\n{B}"),
    "related links": (f"<body><article><p>{A}</p><div class=related><ul><li><a href=1>One more story here</a><li><a href=2>Another story</a></ul></div></article>", A),
    "comments": (f"<body><article><p>{A}</p></article><section id=comments><article><p>{B}</p><p>{C}</p></article></section>", A),
    "comments as main articles": (f"<body><div><p>{A}</p><p>{B}</p></div><div class=comment><p>{C}</p></div>", f"{A}\n{B}"),
    "sidebar": (f"<body><div class=content><p>{A}</p></div><div class=sidebar><p>{B}</p><p>{C}</p></div>", A),
    "aside inside": (f"<body><article><p>{A}</p><aside><p>{B}</p></aside><p>{C}</p></article>", f"{A}\n{C}"),
    "cookie notice": (f"<body><div class='cookie-notice'><p>{B}</p></div><article><p>{A}</p></article>", A),
    "adverts": (f"<body><article><p>{A}</p><div class=ad><p>{B}</p></div><div class='advert-box'>Buy</div><p>{C}</p></article>", f"{A}\n{C}"),
    "teasers and a story": (f"<body><article><h2>One</h2><p>Short.</p></article><article><h2>Two</h2><p>{A}</p><p>{B}</p></article><article><p>Other.</p></article>", f"Two\n{A}\nB".replace("\nB", f"\n{B}")),
    "teaser articles beside a story without": (f"<body><div><article><p>Short one.</p></article></div><div><p>{A}</p><p>{B}</p><p>{C}</p></div>", f"{A}\n{B}\n{C}"),
    "table layout": (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><p>{A}</p><p>{B}</p></td></tr></table>", f"{A}\n{B}"),
    "inline markup": (f"<body><article><p>{A} <b>bold\n text</b>, <a href=x>link</a>.<p>{B}</article>", f"{A} bold text, link.\n{B}"),
    "references": (f"<body><article><p>&lt;a&gt; &amp; &#233;&nbsp;{A}</p></article>", f"<a> & é {A}"),
    "scripts and styles": (f"<body><article><style>p{{}}</style><p>{A}</p><script>var x='<p>no</p>';</script><noscript>Turn it on</noscript></article>", A),
    "hidden": (f"<body><article><p>{A}</p><p hidden>{B}</p><div aria-hidden=true>{C}</div></article>", A),
    "roles": (f"<body><div role=banner>Site</div><div role=navigation>{B}</div><div role=main><p>{A}</p><p>{C}</p></div>", f"{A}\n{C}"),
    "list and quote": (f"<body><main><p>{A}</p><ul><li>one<li>two</ul><blockquote>{B}</blockquote><pre>x  =\n1</pre></main>", f"{A}\none\ntwo\n{B}\nx = 1"),
    "unclosed": (f"<body><article><p>{A}<p>{B}<div>{C}", f"{A}\n{B}\n{C}"),
    "text without elements": (f"{A}", A),
    "words around": ("<body>" + "".join(f"<div>Word {i}</div>" for i in range(9)) + f"<h1>T</h1><p>{A}</p><p>{B}</p>" + "".join(f"<div>Note {i}</div>" for i in range(9)), f"T\n{A}\n{B}"),
    "short blocks at the edges": (f"<body>{LINKS}<h1>T</h1><p>By someone</p><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p><p>So it goes.</p><p>The end.</p><p>Yes.</p>", f"T\nBy someone\n{A}\n{B}\n{C}\n{D}\nSo it goes.\nThe end.\nYes."),
    "paragraphs of other elements": (f"<body>{LINKS}<div>Once.</div><div>{A}</div><div>{B}</div><div>The end.</div>", f"Once.\n{A}\n{B}\nThe end."),
    "lines of the body itself": (f"<body>{LINKS}Once.<br><br>{A}<p>{B}</p>The end.", f"Once. {A}\n{B}\nThe end."),
    "wrapper nav-open": (f"<body><div class='page nav-open'>{NAV}<article><h1>T</h1><p>{A}</p></article>{FOOT}</div>", f"T\n{A}"),
    "wrapper comments-open": (f"<body><main><div class='post comments-open'><p>{A}</p><p>{B}</p></div></main>", f"{A}\n{B}"),
    "wrapper newsletter-on": (f"<body class=x><div id=newsletter-on><p>{A}</p><p>{B}</p><p>Tiny.</p></div>", f"{A}\n{B}\nTiny."),
    "wrapper with a mere name": (f"<body><div class='menu site'>{NAV}<div><h1>T</h1><p>{A}</p><p>{B}</p></div>{FOOT}</div>", f"T\n{A}\n{B}"),
    "inline wrapper with a name": (f"<body><app-root class='menu'><div><p>{A}</p><p>{B}</p></div></app-root>", f"{A}\n{B}"),
    "named post beside long comments": (f"<body><div class='promo story'><h1>T</h1><p>{A}</p><p>{B}</p></div><div class=comments><p>{C}</p><p>{D}</p></div>", f"T\n{A}\n{B}"),
    "no-sidebar and a sidebar": (f"<body><div class='no-sidebar'><p>{A}</p><p>{B}</p></div><div class=sidebar><p>{C}</p></div>", f"{A}\n{B}"),
    "inline advert": (f"<body><article><p>{A} <span class=ad>Buy now</span> {B}</p></article>", f"{A} {B}"),
    "a column of short lines": ("<body><div>" + "".join(f"<div><span>Entry {i} of the</span> <i>long list</i></div>" for i in range(60)) + f"</div><div><p>{A}</p><p>{B}</p><p>Tiny.</p></div>", f"{A}\n{B}\nTiny."),
    "table of figures": ("<body><table>" + "".join(f"<tr><td>{i}</td><td>{i * i} units</td></tr>" for i in range(200)) + f"</table><section><p>{A}</p><p>{B}</p></section>", f"{A}\n{B}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    html, want = LAYOUTS[name]
    assert html_text.main_text(html) == want


def test_ratios_decide(monkeypatch):
    def changed():
        return {name for name, (html, want) in LAYOUTS.items() if html_text.main_text(html) != want}

    assert not changed()
    monkeypatch.setattr(html_text, "ratios_of", lambda lines, boost: [1.0] * len(lines))
    assert {"a column of short lines", "table of figures"} <= changed()


PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.mark.skipif(not os.path.isfile(PAGES), reason="no test data")
def test_ratios_decide_on_noisy_pages_and_wrappers_change_nothing(monkeypatch):
    import pyarrow.parquet as pq

    pages = [h for h in pq.read_table(PAGES).column("html").to_pylist() if h]
    want = [html_text.main_text(h) for h in pages]
    assert all(want)
    for name in ("page nav-open", "site comments-open", "newsletter-on", "has-sidebar menu"):
        wrapped = [h.replace("<body>", f"<body><div class='{name}'>").replace("</body>", "</div></body>") for h in pages]
        assert [html_text.main_text(h) for h in wrapped] == want
    pages, want = zip(*[(h, w) for h, w in zip(pages, want) if len(w) > 100])  # a story must be more than the noise's lines
    want = list(want)
    noise = "<div>" + "".join(f"<div><span>Entry {i}</span> <i>of</i> <b>a long</b> <i>list</i></div>" for i in range(80)) + "</div>"
    noisy = [h.replace("<article>", f"{noise}<section>").replace("</article>", f"</section>{noise}") for h in pages]
    assert [html_text.main_text(h) for h in noisy] == want
    monkeypatch.setattr(html_text, "ratios_of", lambda lines, boost: [1.0] * len(lines))
    assert sum(html_text.main_text(h) != w for h, w in zip(noisy, want)) > len(pages) / 2


def test_odd_pages(spark):
    began = time.process_time()
    deep = "<div>" * 30_000 + A + "<b>" * 30_000 + "<p>" + B + "</section>" * 30_000
    assert html_text.main_text(deep) == f"{A}\n{B}"
    long = "<article>" + "".join(f"<p>{A}</p>" for _ in range(20_000)) + "</article>"
    assert html_text.main_text(long) == "\n".join([A] * 20_000)
    assert time.process_time() - began < 30
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", LAYOUTS["article"][0], "x", 1)] * 2 + [(None, None, None, None, None), (2, "", "", "", 0)]
    got = html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.text for r in got) == ["", "", *[LAYOUTS["article"][1]] * 2]
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0
