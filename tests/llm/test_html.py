"""Pages against a plain parser and plain differencing."""

from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import html_text
from tessera.llm.markup import FRAME_NAMES, FRAME_ROLES, HEADS, text_blocks

RNG = np.random.default_rng(21)
WORDS = ["".join(RNG.choice(list("klmnopqr"), 5)) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.mark.parametrize(
    "attrs",
    ['style="overflow:hidden"', 'data-id="comments"', 'title="grid=ad"', 'class="content no-sidebar"', 'class="overflow-hidden"', 'id="side-effects"', 'data-role="navigation"', "data-x='class=\"ad\"'", 'aria-hidden="false"', 'class="ad-hoc"', 'title="a > b"', 'class=plain data-hidden="x"'],
)
def test_names_inside_other_names_and_values_mark_nothing(attrs):
    assert text_blocks(f"<div {attrs}><p>Only text.</p></div>") == [("Only text.", False, False)]


@pytest.mark.parametrize("attrs", ['class="ad"', "class='x sidebar'", "id=comments", "hidden", 'aria-hidden="true"', 'role="navigation"', 'CLASS="Cookie-Banner y"', 'data-a="1" class="newsletter"'])
def test_whole_names_mark_an_element_as_frame(attrs):
    assert text_blocks(f"<div {attrs}><p>Off.</p></div><p>On.</p>") == [("Off.", True, False), ("On.", False, False)]


def test_an_article_keeps_its_own_parts():
    page = '<header>H</header><article><header class="article-header"><h1>T</h1></header><p class="notice-period">n</p><div class="header">own</div><p>a</p><aside>s</aside><div id="comments">c</div></article><div class="header">x</div>'
    assert [b for b, frame, _ in text_blocks(page) if not frame] == ["T", "n", "own", "a"]


def test_a_menu_over_short_notes_goes(spark):
    menu = prose(20)
    notes = [f"note of {prose(4)}" for _ in range(4)]
    df = spark.createDataFrame([(k, f"http://a/n/{k}", f"<div>{menu}</div><p>{n}</p>") for k, n in enumerate(notes)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == dict(enumerate(notes))


def test_copies_that_differ_in_a_date_keep_their_text(spark):
    text = [prose(40) for _ in range(3)]
    page = lambda day: "".join(f"<div>{x}</div>" for x in [*text, day])
    for days in (("3 March", "4 April"), ("Updated 3 hours ago", "Updated 5 hours ago"), ("1", "2")):
        df = spark.createDataFrame([(k, f"http://a/{k}", page(d)) for k, d in enumerate(days)], "page_id long, url string, html string")
        assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == {k: "\n\n".join([*text, d]) for k, d in enumerate(days)}


class Plain(HTMLParser):
    """Blocks of well-formed pages: frames are skipped as a whole."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.text = [], [], ""

    def flush(self):
        if line := " ".join(self.text.split()):
            frame, inside = any(f for _, f, _ in self.open), any(c for _, _, c in self.open)
            self.out += [] if frame else [(line, inside)]
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag not in ("b", "i"):
            self.flush()
            inside, a = any(c for _, _, c in self.open), dict(attrs)
            names = set((a.get("class") or "").lower().split()) | set((a.get("id") or "").lower().split())
            named = (names & FRAME_NAMES) - (HEADS if inside else set())
            marked = bool(named) or a.get("role") in FRAME_ROLES or "hidden" in a
            frame = tag in ("nav", "footer", "aside", "form", "script", "style") or tag == "header" and not inside or marked and (tag != "article" or inside)
            self.open.append((tag, frame, tag in ("article", "main")))

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "br"):
            self.flush()
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.text += data


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def random_page(rng, menu, foot):
    attrs = ["", ' class="ad"', ' id="comments"', ' class="content no-sidebar"', ' style="overflow:hidden"', ' data-id="ad"', " role='banner'", " hidden", ' class="notice-period"']

    def block(depth):
        kind = rng.choice(["p", "div", "nav", "article", "header", "section", "aside", "ul"], p=[0.45, 0.2, 0.04, 0.09, 0.05, 0.1, 0.03, 0.04])
        if kind == "p" or depth > 2:
            a, b = prose(int(rng.integers(3, 9))), prose(int(rng.integers(1, 4)))
            return f"<p{rng.choice(attrs, p=[0.84] + [0.02] * 8)}>{a} <b>{b}</b><br>&amp; {prose(2)}</p>"
        return f"<{kind}{rng.choice(attrs)}>" + "".join(block(depth + 1) for _ in range(int(rng.integers(1, 4)))) + f"</{kind}>"

    return "<div>" + "".join(f"<p>{m}</p>" for m in menu) + "</div>" + "".join(block(0) for _ in range(int(rng.integers(1, 5)))) + f"<div>{foot}</div>"


def test_random_pages_agree_with_a_plain_parser(spark):
    rng = np.random.default_rng(12)
    menu, foot = [prose(2) for _ in range(5)], prose(5)
    pages = [(k, f"http://h{k % 4}/{k % 7}/{k:03d}", random_page(rng, menu[: k % 6], foot)) for k in range(200)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    parsed = {}
    for k, _, source in pages:
        p = Plain()
        p.feed(source)
        p.flush()
        parsed[k] = p.out
    for h in range(4):
        own = sorted((p for p in pages if p[0] % 4 == h), key=lambda p: p[1])
        texts = {k: [x for x, _ in parsed[k]] for k, _, _ in own}
        host = list({tuple(texts[k]): None for k, _, _ in own})  # pages with the same lines are one, at the first one's place
        for k, _, _ in own:
            lines, i, gone = texts[k], host.index(tuple(texts[k])), set()
            for j in [j for j in (i - 1, i + 1, i - 2, i + 2) if 0 <= j < len(host)][:2]:
                shared, other = common(lines, host[j]), common(host[j], lines)
                long = lambda x: html_text._letters(x) >= html_text.LETTERS
                if any(long(x) for n, x in enumerate(lines) if n not in shared) or any(long(x) for n, x in enumerate(host[j]) if n not in other):
                    gone |= shared
            assert got[k] == "\n\n".join(x for n, (x, inside) in enumerate(parsed[k]) if inside or n not in gone), k
