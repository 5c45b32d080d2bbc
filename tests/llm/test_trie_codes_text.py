"""Conversation trie, vector codes and main text against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import clashing
from vitrine.llm.conversation_trie import conversation_trie
from vitrine.llm.running import running
from vitrine.llm.template_text import Page, extract_text, main_text, template_tokens, templates
from vitrine.llm.vector_codes import Orchard, decode, limit, vector_codes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- running totals ------------------------------------------------------------------

def test_running_totals_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.7 else rng.randrange(20), i, rng.randrange(-5, 50), rng.getrandbits(60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, n bigint, c bigint").repartition(7)
    got = {(r.k, r.o): (r.pos, r.n, r.c) for r in running(df, "k", ["o"], ("n",), ("c",)).collect()}
    pos, total, code = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, o, n, c in sorted(rows):
        pos[k] += 1
        total[k] += n
        code[k] = (code[k] + c) % (1 << 60)
        assert got[k, o] == (pos[k], total[k], code[k])
    assert len(got) == len(rows) and running(df.limit(0), "k", ["o"], ("n",), ("c",)).count() == 0


# --- conversations -----------------------------------------------------------------

def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            code = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, code, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    said = {c: [t[3:] for t in turns] for c, turns in own.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = said.get(c - int(math.fmod(c, 20)), [])[:h] + said[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        own_saving = (len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        down = [below(k) for k in kids[p]]
        return (1 if not down else sum(x for x, _ in down)), own_saving + sum(y for _, y in down)
    out = []
    for p, who in members.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(seed=3):
    rng = random.Random(seed)
    texts = ["hello there", "hi", "", None, "a b  c\td", "ça va über", "again again"]
    rows = []
    for c in [*range(0, 130), 4001, 4003, -7, -20, -41, 999_999_999_999]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts[:3] if rng.random() < .7 else texts)))
    for c in range(200, 320):  # a large group of copies
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same too"), (c, 2, "user", "x"), (c, 3, "user", "y")]
    rows += [(400, t, "user", f"turn {t} " + "w " * (t % 5)) for t in range(700)]  # one long conversation
    rows += [(401, t, "user", f"turn {t} " + "w " * (t % 5)) for t in range(500)]  # nearly its prefix
    rows += [(None, 0, "user", "no id"), (50, None, "user", "first"), (51, 0, "user", "tie"), (51, 0, "user", "tie"),
             (52, 0, "zzz", "tie"), (52, 0, "user", "other"), (600, 0, "user", "long " * 50_000)]
    rng.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark):
    rows = odd_conversations()
    df = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).withColumns(
        {c: F.lit("x") for c in ("pos", "depth", "s1", "n_words", "weight", "leaf")}).repartition(6)
    got = conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    import sys
    sys.setrecursionlimit(5000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows)
    assert conversation_trie(df.limit(0)).count() == 0


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    # conversations whose own turns all lie in the part that an absent base replaces
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1]
    df = spark.createDataFrame([(c, 0, "user", "one") for c in ids], "conv_id bigint, turn bigint, role string, text string")
    rows = conversation_trie(df).collect()
    ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [tuple(r) for r in rows] == [(ids[0], 0, None, len(ids), 0, 1, 0, ends)]


# --- vector codes ------------------------------------------------------------------

def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    dim = min(((i is None, i or 0, v) for i, _, v in kept if len(v) % parts == 0))[2]
    kept = [k for k in kept if len(k[2]) == len(dim)]
    size = len(dim) // parts
    first = {}
    for i, _, v in sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2])):
        first.setdefault(i, v)
    books = [[v[p * size:(p + 1) * size] for v in list(first.values())[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            cells = defaultdict(list)
            for _, _, v in kept:
                cells[near(v[p * size:(p + 1) * size], books[p])[1]].append(v[p * size:(p + 1) * size])
            for k, xs in cells.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, v in kept:
        hits = [near(v[p * size:(p + 1) * size], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits)))
    return sorted(out, key=str), books


def test_codes_match_brute_force(spark):
    rng = random.Random(4)
    vec = lambda n=16: [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(n)]
    rows = [(i, vec(), rng.choice([None, 0, 1, 2])) for i in range(5, 150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(100)]  # one common vector
    rows += [(9, vec(), 3), (9, vec(), 3), (9, rows[4][1], None), (None, vec(), 0), (300, None, 1), (301, [], 1),
             (302, [0.5, None] * 8, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] + [0.0] * 15, 1),
             (305, vec(8), 1), (1, vec(13), 1), (306, [3.0e38] + [0.0] * 15, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns(
        {c: F.lit("x") for c in ("code", "error", "v", "cell", "n")}).repartition(5)
    usable = [r for r in rows if not (r[1] and any(x is not None and abs(x) > 1e30 for x in r[1]))]
    want, books = codes_by_hand([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l)
                                 for i, v, l in usable])
    coded, got = vector_codes(df)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert got.transpose(1, 0, 2).tolist() == books
    sample = coded.where("vec_id between 200 and 299").collect()
    v = np.floor(4096 * np.float32(rows[[r[0] for r in rows].index(200)][1]).astype(float)).astype(int)
    assert {r.error for r in sample} == {int(((v - decode([sample[0].code], got)[0]) ** 2).sum())}
    empty, none = vector_codes(df.limit(0))
    assert empty.count() == 0 and len(none) == 0
    few, small = vector_codes(df.where("vec_id between 10 and 12"))
    assert few.count() == 3 and small.shape[0] == 3 and {r.error for r in few.collect()} == {0}


def test_orchard_is_exact_and_measures_less():
    rng = np.random.default_rng(2)
    centres = rng.integers(-40, 40, (64, 2, 4)) * 50
    search = Orchard(centres)
    x = (centres[rng.integers(0, 64, 4000), rng.integers(0, 2, 4000)] + rng.integers(-9, 9, (4000, 4)))
    part = rng.integers(0, 2, 4000)
    entry, distance = search.nearest(x, part)
    full = ((x[:, None, :] - centres[:, part].transpose(1, 0, 2)) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()  # argmin: ties to the lower
    assert search.measured < 0.6 * full.size
    same = Orchard(np.zeros((5, 1, 3), np.int64))
    assert same.nearest(np.ones((7, 3), np.int64), np.zeros(7, int))[0].tolist() == [0] * 7
    assert 64 * (2 * limit(64)) ** 2 < 1 << 63


# --- main text ---------------------------------------------------------------------

def plain(html):
    return main_text(html.encode(), set(), set())


@pytest.mark.parametrize("html, text", [
    ("", ""), ("just text", "just text"), ("<p>a</p><p>b", "a b"), ("<article></article><p>out</p>", ""),
    ("<article><p>one<b>two</b> three<br>four</p></article>", "onetwo three four"),
    ("<article><header><h1>T</h1></header><p>x &amp;&lt;&#233;&nbsp;&copy y &bogus; &#xD800;</p></article>",
     "T x &<é © y &bogus; �"),
    ("<header><h1>Site</h1></header><nav>n</nav><main><p>m</p><aside>a</aside></main><footer>f</footer>", "m"),
    ("<main><div>menu words</div><article>real</article></main>", "real"),
    ("<article>a<article class='comment'>c</article><div id=comments><p>d</p></div>b</article>", "a b"),
    ("<body class='has-sidebar'><div class='with-sidebar'>t</div><div class='sideBar left-sidebar'>s</div>", "t"),
    ("<div class='cookie-notice'>c</div><div role=alert>r</div><p hidden>h</p><p style='display: none'>d</p><p>ok", "ok"),
    ("<article><script>var a='</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><p>y<!--", "y"),
    ("<article>a < b <3 <> c</article>", "a < b <3 <> c"), ("<p title='a>b'>q</p><p title='x>z", "q z"),
    ("<form><article>in a form</article></form>", "in a form"), ("<article>keep<form>f<select><option>o</select></form>s", "keep s"),
    ("<aside><article>teaser</article></aside><article>told</article>", "told"), ("<title>t</title><p>u", "u"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ("<article><p><b>bold<br><p>next</article><footer>f", "bold next"), ("<textarea><p>x</textarea>y<script>", "y"),
])
def test_pages_by_hand(html, text):
    assert plain(html) == text


def div_page(i, rng, host):
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) for _ in range(k)) + f" {i}"
    body = [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
    menu = "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(6))
    extra = "<div class=x><b>Only half of the pages</b></div>" if i % 2 else ""
    html = (f"<html><body><div class=logo>Daily {host}</div><div class=c1><ul>{menu}</ul></div><div class=c2>"
            + "".join(f"<p>{b}</p>" for b in body) + f"</div>{extra}<div class=c3>Printed in Ulm</div></body></html>")
    return html, " ".join(body)


def template_table(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(120):
        host = "hot.example" if i < 90 else "warm.example" if i < 110 else f"lone{i}.example"
        html, text = div_page(i, rng, host)
        rows.append((i, f"https://{'me@' if i % 3 else ''}{host.upper() if i % 2 else host}/p/{i}", html))
        want[i] = text
    article = lambda i: (f"<html><body><article><h1>Head {i}</h1><p>Share this story</p><p>story {i} told</p>"  # noqa: E731
                         f"<p>a line of most</p></article><div>rest</div></body></html>")
    for i in range(200, 230):
        html = article(i) if i != 229 else article(i).replace("<p>a line of most</p>", "")
        rows.append((i, f"http://art.example/{i}", html))
        want[i] = f"Head {i} story {i} told" + ("" if i == 229 else " a line of most")
    for i in range(300, 340):  # copies of one page are one page: no template
        rows.append((i, f"http://copy.example/{i}", article(0)))
        want[i] = "Head 0 Share this story story 0 told a line of most"
    rows += [(400, None, "<p>no host</p>"), (401, "http://hot.example/n", None), (None, "http://x.example", "<p>no id</p>"),
             (200, rows[120][1], rows[120][2])]
    want |= {400: "no host", 401: "", None: "no id"}
    return rows, want


def test_templates_leave_the_slots(spark):
    rows, want = template_table(spark)
    rows = [r for r in rows if r[0] != 401]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("x") for c in ("host", "body", "texts", "menus", "kind", "token", "text")}).repartition(9)
    for size in (1 << 20, 0):  # broadcast and ordinary join
        got = extract_text(df, broadcast_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.page_id is not None and r.page_id < 110:
                # the half-page block is template text too; lone hosts keep theirs
                assert r.text == want[r.page_id], r
            elif r.page_id is None or r.page_id >= 200:
                assert r.text == want[r.page_id], r
            else:
                assert want[r.page_id] in r.text and "Printed in Ulm" in r.text
            assert r.n_chars == len(r.text)
    tokens = template_tokens(df)
    hot = [r for r in tokens.where("host = 'hot.example'").collect()]
    by_class = defaultdict(set)
    for r in hot:
        by_class[r.class_id].add(r.name)
        assert r.pages <= 90 and r.class_size >= 1
    assert any({"/html", "/html/body", "/html/body/div[logo]"} <= names for names in by_class.values())
    # equal classes whatever the partitions
    again = template_tokens(df.repartition(2))
    key = lambda d: sorted(tuple(r) for r in d.select("host", "kind", "token", "pages", "class_id").collect())
    assert key(tokens) == key(again)
    assert {r.host for r in templates(tokens).collect()} == {"hot.example", "warm.example", "art.example"}


def test_empty_and_broken_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in extract_text(df).orderBy("page_id").collect()] == [(1, "u", "", 0), (2, "u", "", 0)]
    assert extract_text(df.limit(0)).count() == 0
    broken = spark.sql("select 1L as page_id, 'http://h/' as url, cast(unhex('3C703E61FF623C2F703E') as string) as html")
    assert extract_text(broken).first().text == "a�b"
    long = "<p>" + "word " * 400_000 + "</p>" + "<i>" * 3000 + "<a \"" * 2000
    assert len(Page(long).blocks) >= 1
