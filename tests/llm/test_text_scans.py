"""Secrets, licences, token ids, pages: each row by itself."""

import hashlib
import json
import re
import textwrap
import time

import numpy as np
import pytest

from scanloom.llm import bpe, licenses, pages, queries, secrets


def test_base_spans_against_plain_search(table):
    texts = [
        "password=abcdefgh1 and Token : 'zz/==.-_12' api_key=short", "AKIA" + "A" * 12 + " AKIA123", "x" + "0123456789abcdef" * 2 + "g" + "f" * 31, "", None,
        "sécret secret=é12345678", 'PASSWD "=" SECRET="a.b-c_d=e+f/g"', "token=token=password=12345678", "q " * 20000 + "apikey:1234567890",
    ]
    got = {r.doc_id: r.secrets for r in secrets.scan(table(texts)).collect()}
    assign = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted((s.start, s.end, s.kind) for s in got[i] if s.kind != "guess") == sorted(want)


def test_guess_cost_orders_values():
    cost = secrets.log_guesses
    assert cost("") == 0
    for weak in ("password123", "qwertyuiop", "aaaaaaaaaaaaaaaa", "abcabcabcabc", "changeme2024", "P@ssw0rd", "20240131"):
        assert cost(weak) < secrets.LOG_GUESSES < cost("xK9#mPq2$vLw7")
    assert cost("ab" * 50_000) < 10  # linear time on long values


def brute_cost(value):
    """The cheapest segmentation, by trying every segment, for values of brute force and words only."""
    char = np.log10(secrets.alphabet(value))
    best = [0.0]
    for e in range(1, len(value) + 1):
        options = [best[e - 1] + char]
        for s in range(e - 2):
            if value[s:e] in secrets.RANK:
                options.append(best[s] + np.log10(secrets.RANK[value[s:e]]) + 0.3)
        best.append(min(options))
    return best[-1]


def test_guess_cost_is_a_minimum():
    for value in ("xpasswordy", "thetokenbox", "forwithq"):
        assert secrets.log_guesses(value) == pytest.approx(brute_cost(value))


def brute_cost_of_all_kinds(value):
    """The cheapest segmentation, by trying every stretch as every kind of segment."""
    char, found = np.log10(secrets.alphabet(value)), set(secrets.dates(value))
    steps = (lambda a, b: b in secrets.NEAR.get(a, ()), lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(b) - ord(a) == -1)
    best = [0.0]
    for e in range(1, len(value) + 1):
        options = [best[e - 1] + char]
        for s in range(e - 2):
            part = value[s:e]
            if (word := secrets.word_cost(part)) is not None:
                options.append(best[s] + word)
            if any(all(step(a, b) for a, b in zip(part.lower(), part.lower()[1:])) for step in steps):
                options.append(best[s] + secrets.run_cost(e - s))
            if (s, e) in found:
                options.append(best[s] + secrets.date_cost(e - s))
            options += [best[s + u] + secrets.repeat_cost(e - s, u) for u in range(1, secrets.LONGEST_UNIT + 1)
                        if e - s >= 2 * u and part[u:] == part[:-u]]
        best.append(min(options))
    return best[-1]


def test_guess_cost_is_a_minimum_over_all_kinds():
    rng = np.random.default_rng(7)
    parts = ["monkey", "uiop", "qwerty", "abcd", "aaa", "ab", "abab", "2024", "20240131", "31", "x", "Q", "9", "zzzzzzzz", "P@ss", "word", "654", "\u00e9", "\u0130", "asdasd"]
    values = ["monkeyuiop", "", "12024-01-3199"]
    for k in range(400):
        values.append("".join(rng.choice(parts if k % 2 else list("ab12q"), rng.integers(1, 9 if k % 2 else 30))))
    for value in values:
        assert secrets.log_guesses(value) == pytest.approx(brute_cost_of_all_kinds(value)), value
    assert secrets.log_guesses("monkeyuiop") < 4


def test_name_before_a_key_word_has_no_bound(table):
    value = "Xy(9)k#2,Qw!z"
    texts = [f'{"z" * n}password="{value}"' for n in (0, 1, 41, 100_000)]
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.secrets] for r in secrets.scan(table(texts)).collect()}
    assert got == {i: [value] for i in range(4)}


def test_guess_spans(table):
    texts = ["db_pwd: 'k3$Jq!9zPw%x'", "pwd=changeme", "auth-key=qwertyuiop", "password=b7db7aa4a5fcc78305"]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in secrets.scan(table(texts)).collect()}
    assert got == {0: [(9, 21, "guess")], 1: [], 2: [], 3: [(0, 27, "assign")]}


def test_guess_values_are_whole(table):
    long = "token=abcdefgh!K9#xQ7$"
    texts = ['password: "Xy(9)k#2,Qw!z"', long, 'secret = "velvet orbit, kettle (nine) <grape>"\nnext "line"', "pwd='it\\'s K9#x Q7$w'", "f(pwd=k3$Jq!9zPw%x), y", "pwd=k3$J;q!9z|Pw%x{1}", '{"pwd":"k3$Jq!9,zPw%x","token":"changeme"}',
             "password=b7db7aa4a5fcc78305, (token=b7db7aa4a5fcc78305)", 'pwd="k3$Jq!9zPw%x\nopen"']
    want = ["Xy(9)k#2,Qw!z", "abcdefgh!K9#xQ7$", "velvet orbit, kettle (nine) <grape>", "it\\'s K9#x Q7$w", "k3$Jq!9zPw%x", "k3$J;q!9z|Pw%x{1}", "k3$Jq!9,zPw%x", None, "k3$Jq!9zPw%x"]
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.secrets if s.kind == "guess"] for r in secrets.scan(table(texts)).collect()}
    assert got == {i: [w] if w else [] for i, w in enumerate(want)}
    assert [(s[0], s[1], s[2]) for s in secrets.find(long)] == [(0, 14, "assign"), (6, 22, "guess")]


def test_secret_query_digest(spark, table, tmp_path):
    table(["a token=12345678 b", "", None, Ellipsis, "pwd='k3$Jq!9zPw%x'"]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op2_secret_scan(spark, str(tmp_path)).collect()}
    assert rows[0].spans == "assign:2:16" and rows[0].base_sha256 == hashlib.sha256(b"assign:2:16").hexdigest()
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() == rows[None].base_sha256
    assert rows[4].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[4].spans == "guess:5:17"


def test_licences(table):
    texts = ["a b\nReleased under the MIT License.\nc", "Licensed under CC BY-NC 4.0.", "my driving licence and copyright", None, "",
             "x\n" + licenses.TEMPLATES["MIT-text"].replace(" deal", " trade") + "\ny", "no such wording\n" * 5000 + "Licensed under the Apache License, Version 2.0."]
    got = {r.doc_id: r.notices for r in licenses.scan(table(texts)).collect()}
    assert [(n.license, n.first_line, n.last_line, n.differences) for n in got[0]] == [("MIT", 1, 2, [])]
    assert [n.license for n in got[1]] == ["CC-BY-NC-4.0"]
    assert got[2] == got[3] == got[4] == []
    assert [(n.license, n.differences) for n in got[5]] == [("MIT-text", ["deal -> trade"])]
    assert [(n.license, n.first_line) for n in got[6]] == [("Apache-2.0", 5000)]


def test_wrapped_and_inner_licences(table):
    mit, bsd, gpl = (licenses.TEMPLATES[k] for k in ("MIT-text", "BSD-3-Clause-notice", "GPL-2.0-header"))
    prose = "some other words stand here " * 60
    texts = ["\n".join(textwrap.wrap(mit, 78)), "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", prose + mit + " " + prose,
             "x\n" + "\n".join(" * " + x for x in textwrap.wrap(gpl, 60)) + "\n\n * " + bsd, f"{prose} {bsd} Released under the MIT License. Licensed under CC BY 4.0. {prose}", (bsd + " ") * 50]
    got = {r.doc_id: [(n.license, n.first_line, n.last_line, n.differences) for n in r.notices] for r in licenses.scan(table(texts)).collect()}
    assert got[0] == [("MIT-text", 0, texts[0].count("\n") + 1, [])]
    assert got[1] == [("BSD-3-Clause-notice", 0, 2, [])]
    assert got[2] == [("MIT-text", 0, 1, [])]
    lines = texts[3].count("\n") + 1
    assert got[3] == [("GPL-2.0-header", 1, lines - 2, []), ("BSD-3-Clause-notice", lines - 1, lines, [])]
    assert [n[0] for n in got[4]] == ["BSD-3-Clause-notice", "MIT", "CC-BY-4.0"]
    assert got[5] == [("BSD-3-Clause-notice", 0, 1, [])] * 50


def test_licence_templates_find_themselves():
    own = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert own.judge(text)["license"] == name and own.judge(text)["differences"] == []


def test_token_ids_round_trip(table):
    import tiktoken

    path, pattern = queries.rank_file()
    ranks = bpe.encoding(bpe.rank_bytes(path), pattern)
    assert isinstance(ranks, tiktoken.Encoding)
    texts = ["Hello world", "", None, "a\n\n  b \t c", "é😀 naïve 123 x's", "word " * 60_000, "x" * 150_000, " " * 5_000 + "y", "<|endoftext|>", "A1\n" * 50_000]
    rows = bpe.decode(bpe.encode(table(texts), path, pattern), path, pattern).collect()
    digests = {r.doc_id: r for r in bpe.digests(table(texts), path, pattern).collect()}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == ranks.encode_ordinary(t) and bytes(r.raw) == t.encode()
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


PAGES = [
    ("<html><body><nav><a href=x>Home</a><a href=y>News</a></nav><div class='ad'>Buy now cheap things</div><article><h1>A title</h1><p>One &amp; two\n  three.<p>Four <b>fi</b>ve"
     "<script>var x='</p>';</script></article><footer>&copy; all rights</footer>", "A title One & two three. Four five"),
    ("<body><div id=menu><ul><li><a href=1>a</a></ul></div><div class=content><h1>Head line here</h1><p>Some long text of words that stands alone.</p><aside>Side words</aside>"
     "<p>And more text of words.</p></div><div class='comments'><p>Nice post I like it a lot</p></div><form><input><button>Send</button></form></body>",
     "Head line here Some long text of words that stands alone. And more text of words."),
    ("", ""), (None, ""), ("<p", ""), ("plain words only", "plain words only"), ("<!-- open <p>words", ""), ("<script>never ends <p>words", ""),
    ("<div class='cookie-notice'>We use cookies on this site</div>", ""),
    ("<body><p>" + "word " * 40_000 + "</p></body>", ("word " * 40_000).strip()),
]


def test_pages(spark):
    rows = [(i, f"http://x/{i}", h, "t", 3) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "t", 3), (0, "http://x/0", PAGES[0][0], "t", 3)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r.page_id or 0][1]
        assert (r.text, r.n_chars) == (want, len(want))


def brute_best(scores):
    options = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    return max(0.0, max(options)[0])


def test_scan_finds_the_best_run():
    rng = np.random.default_rng(5)
    for _ in range(30):
        page = "".join(rng.choice(["<p>w w</p>", "<li><a>x</a></li>", "<div>", "</div>", "<p>v</p>", "<footer>f f f</footer>"]) for _ in range(12))
        parts = [p for p in pages.tokens(page) if p[0] != "blank"]
        scores = [pages.prior(p[0]) * (p[4] or 1) for p in parts]
        text = pages.main_text(page, {})
        assert bool(text) == any(s > 0 for s in scores)
        best = brute_best(scores)
        runs = [(a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1) if abs(sum(scores[a:b]) - best) < 1e-9]
        words = {" ".join("".join(p[1] if not p[2] else " " for p in parts[a:b]).split()) for a, b in runs}
        assert not text or text in words


def test_empty_tables(spark, table):
    none = table(["x"]).where("false")
    path, pattern = queries.rank_file()
    assert secrets.scan(none).count() == licenses.scan(none).count() == bpe.digests(none, path, pattern).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_rows(spark, tmp_path):
    assert json.dumps(sorted(queries.QUERIES)) == json.dumps(sorted(f"op{n}_{k}" for n, k in enumerate(
        ("license_scan", "secret_scan", "simhash", "neighbours", "decontaminate", "suffix_dedup", "main_text", "byte_bpe", "line_runs", "toxicity"), 1)))


def test_scripts_may_hold_signs_of_markup():
    page = """<body><script>for (i=0;i<n;i++) { s = "it's" }</script><nav>Home</nav><style>a>b{c:"<d"}</style><article><p>the real words of this page</p></article></body>"""
    assert pages.main_text(page, {}) == "the real words of this page"
    assert pages.main_text("<article><p>one two three</p><SCRIPT>if (a<b) x()</script ><p>four five</p></article><script>never closed <p>six", {}) == "one two three four five"


def test_time_is_proportional_to_nesting():
    def seconds(page):
        begin = time.perf_counter()
        pages.main_text(page, {})
        return time.perf_counter() - begin

    for unit in ("<div>word ", '<a ">x ', "<b>x</i> ", "<p>x<li>y"):
        assert seconds(unit * 60_000) < 10  # walks over the open elements would take hours


def test_pipeline_stages_work_on_small_slices(spark, monkeypatch):
    """A worker's memory follows 0.5 MB of text, not the batch: what one stage takes is kept while the next ones run."""
    import pyarrow as pa

    from scanloom.llm import simhash, texts

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(texts, "id_text", lambda *a, **k: Rows())
    many = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": ["one two three four " * 1000] * 100})  # 1.9 MB
    run = simhash.fingerprints(None)
    out = list(run(iter([many])))
    assert sum(b.num_rows for b in out) == 100 and len(out) >= 4
    assert max(b.num_rows for b in out) * len("one two three four " * 1000) <= 1 << 19
