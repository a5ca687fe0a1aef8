"""Token alignment against both libraries on whole texts, spelling variants
against all pairs of words, main texts against hand-written pages; awkward rows
for each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairlab.llm import html_consensus, spelling_variants, token_alignment

SMALL = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, local int, a int, word string, host string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", -1, 7, "clash", None) for i, t in rows], SCHEMA)


# -- token alignment

def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def aligned_by_hand(rows):
    """The contract, text by text, with the libraries on whole texts."""
    letters, a_tok = byte_letters(), Tokenizer.from_file(BPE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, holds = [], collections.Counter()
    for i, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            pa = [bytes(letters[c] for c in a_tok.id_to_token(x)) if a_tok.id_to_token(x) != "<|endoftext|>" else b"?" for x in a]
            pb = [b_bytes(x) for x in b]
            if b"".join(pa) != raw or b"".join(pb) != raw:
                a, b = [], []
            else:
                owner_a, owner_b = np.repeat(np.arange(len(a)), [len(x) for x in pa]), np.repeat(np.arange(len(b)), [len(x) for x in pb])
                links = [(a[x], b[y]) for x, y in sorted(set(zip(owner_a.tolist(), owner_b.tolist())))]
                both = sorted(set(np.cumsum([len(x) for x in pa]).tolist()) & set(np.cumsum([len(x) for x in pb]).tolist()))
                for lo, hi in zip([0, *both], both):
                    groups.append(",".join(str(a[k]) for k in dict.fromkeys(owner_a[lo:hi].tolist())) + "|"
                                  + ",".join(str(b[k]) for k in dict.fromkeys(owner_b[lo:hi].tolist())))
        holds.update(set(links))
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = collections.defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return sorted(((i, a, b, g, len(links), sum(holds[k] == top[k[0]] for k in links), sum(holds[k] for k in links), sha)
                   for i, a, b, g, links, sha in out), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in df.collect()), key=str)


ODD = [(1, ""), (2, None), (3, "Hello World"), (3, "Hello World"), (None, "no id"), (4, "  two  spaces\n\n x \t y "),
       (5, "日本語 😀 ﬁ <|endoftext|> x <s> </s> <unk> <0x41>"), (6, "a▁b"), (7, "the the the the the of of"),
       (8, "l'été don't we know​ it\r\n  end"), (9, "The quick brown fox. " * 3000), (10, "x" * 5000), (None, None)]


@pytest.mark.parametrize("name", ["small", "odd"])
def test_alignment_equals_libraries(spark, name):
    rows = ODD if name == "odd" else [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = found(token_alignment.align_documents(table(spark, rows).repartition(3), BPE, PIECES))
    assert got == aligned_by_hand(rows)


def test_alignment_blocks_and_full_bitmaps(spark, monkeypatch):
    """Pairs that hundreds of documents hold are bitmaps; small blocks give the same."""
    rows = [(k, "same words here " * (1 + k % 5) + f"and {k}") for k in range(700)]
    want = aligned_by_hand(rows)
    assert found(token_alignment.align_documents(table(spark, rows).coalesce(1), BPE, PIECES)) == want
    assert found(token_alignment.align_documents(table(spark, rows).repartition(7), BPE, PIECES)) == want


def test_alignment_of_nothing(spark):
    assert token_alignment.align_documents(table(spark, []), BPE, PIECES).collect() == []
    assert found(token_alignment.align_documents(table(spark, [(1, None)]), BPE, PIECES)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_containers_round_trip():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(token_alignment.BLOCK_DOCS, n, replace=False)) for n in (1, 5, 255, 256, 257, 4096)]
    starts = np.cumsum([0, *[len(s) for s in sets]])[:-1]
    values, offsets = token_alignment.containers(np.concatenate(sets), starts)
    for s, lo, hi in zip(sets, offsets, offsets[1:]):
        part = values[lo:hi]
        got = np.flatnonzero(np.unpackbits(part)) if hi - lo == 512 else part.view("<u2")
        assert np.array_equal(got, s)


# -- spelling variants

def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(x == y[:k] + y[k + 1:] for k in range(len(y)))


def pairs_by_hand(words):
    return sorted((x, y) for x in words for y in words if x != y and near(x, y))


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(2, 9))) for _ in range(250)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted((r.word, r.near) for r in spelling_variants.near_words(df).collect()) == pairs_by_hand(words)


def test_near_words_of_long_words(spark):
    """Beyond the depth where edges have one letter, and repeated letters."""
    rng = random.Random(6)
    words = {"a" * n for n in range(20, 60)} | {"ab" * n for n in range(10, 40)}
    for n in (25, 60, 200, 700):
        base = "".join(rng.choice("xyz") for _ in range(n))
        words.add(base)
        for _ in range(12):
            k = rng.randrange(n)
            words |= {base[:k] + base[k + 1:], base[:k] + "x" + base[k:], base[:k] + "y" + base[k + 1:]}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted((r.word, r.near) for r in spelling_variants.near_words(df).collect()) == pairs_by_hand(words)


def variants_by_hand(rows):
    lower, n = {k: k + 32 for k in range(65, 91)}, collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by = collections.defaultdict(list)
    cuts = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cuts[w[:k] + w[k + 1:]].add(w)
    for group in cuts.values():
        for x in group:
            by[x] += [y for y in group if near(x, y)]
    for w in words:
        for k in range(len(w)):
            v = w[:k] + w[k + 1:]
            if v in words:
                by[w].append(v)
                by[v].append(w)
    form = {}
    for w in words:
        best = min(set(by[w]), key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), c, len(set(by[w])), words.get(form[w])) for w, c in words.items())


@pytest.mark.parametrize("name", ["small", "odd", "nothing"])
def test_variants_equal_brute_force(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] if name == "small" else []
    if name == "odd":
        rows = [*ODD, (20, "Grandfather " * 300), (21, "grandfathxr " * 20), (21, "grandfathx×" * 2), (None, "grandfathxr"),
                (22, "éééàààü éééàààü éééàààùü éééàààùü ÉÉÉÀÀÀÜ"), (23, "q" * 9000), (24, "q" * 9001), (25, "q" * 9000),
                (26, "q" * 9001), (27, "12 \u0000 __")]
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n)
                 for r in spelling_variants.group_variants(table(spark, rows)).collect())
    assert got == variants_by_hand(rows)


# -- main texts

NOISE = ('<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as long '
         'sentences say on every single page.</p></div>')


def page(inner, before=NOISE, after="<footer>Imprint and contact, in many words that nobody reads.</footer>"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{inner}{after}</body></html>"


CASES = {
    "article": (page("<article><h1>Title</h1><p>One &amp; two,\n  three.<p>Four<br>five.</article>"), "Title\nOne & two, three.\nFour five."),
    "sections": (page("<main><article><header><h1>T</h1><span>by me</span></header><p>A lead that is short.</p><section><h2>S</h2>"
                      "<p>Long enough text of the first section.</p></section><aside>other pages</aside><section><p>Long enough "
                      "text of the second section.</p></section><div id='comments'><article><p>First! A reader's words that "
                      "are as long as the text.</p></article></div></article></main>"),
                 "T\nA lead that is short.\nS\nLong enough text of the first section.\nLong enough text of the second section."),
    "divs": (page('<div class="wrap with-sidebar"><div class="post-body"><h2>Head</h2><p>Plain text in a division, long enough to be '
                  'read.</p><ul><li>one point</li><li>two points</li><li>three points</li></ul></div><div class="sidebar"><p>Beside it '
                  'stands text that is no part of the article at all.</p></div></div>'),
             "Head\nPlain text in a division, long enough to be read.\none point\ntwo points\nthree points"),
    "adverts": (page('<article><p>Before the advert there is text.</p><div class="ad">Buy, buy, buy these things now!</div>'
                     '<form><input name=q>Search all our pages here</form><p>After it there is more.</p><script>var p="</p>"</script>'
                     '<!-- <p>no</p> --></article>'), "Before the advert there is text.\nAfter it there is more."),
    "bare": ("no markup &lt;b&gt; at <i>all</i>", "no markup <b> at all"),
    "broken": ("<article><p>open <b>bold<p>next <a href='x'>link<td>cell</article", "open bold\nnext link\ncell</article"),
    "empty": ("", ""),
    "only noise": (page(""), ""),
    "table": (page("<article><table><tr><td>a cell of words</td><td>b cell of words</td></tr></table></article>"),
              "a cell of words\nb cell of words"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_main_text(name):
    html, want = CASES[name]
    assert html_consensus.main_text(html, None) == want


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string")
    return sorted(((r.page_id, r.text, r.n_chars) for r in html_consensus.extract_pages(df).collect()), key=str)


def test_consensus_outvotes_a_page(spark):
    """A page whose largest container is another one follows its host; the same page alone does not."""
    usual = page('<div class="c1"><p>' + "The usual text of this host, quite long. " * 5 + '</p></div><div class="x"><p>short</p></div>')
    odd = page('<div class="c2"><p>Little text here, but it counts.</p></div><div class="x"><p>' + "A loud box of another kind. " * 20
               + "</p></div>")
    rows = [(k, "https://User@Host.example:80/a", usual) for k in range(5)] + [(9, "http://host.example/b?c", odd), (10, None, odd),
                                                                               (11, "http://other.example", odd)]
    got = {i: t for i, t, _ in extract(spark, rows)}
    assert got[9] == "Little text here, but it counts."
    assert got[10] == got[11] == ("A loud box of another kind. " * 20).strip()
    assert got[0] == ("The usual text of this host, quite long. " * 5).strip()


def test_extraction_of_awkward_rows(spark):
    long = page("<article>" + "<p>" + "word " * 200_000 + "</p></article>")
    rows = [(1, None, None), (1, "", ""), (None, "nonsense", "<p>some text here"), (2, "http://h/x", long), (2, "http://h/x", long)]
    text = ("word " * 200_000).strip()
    assert extract(spark, rows) == sorted([(1, "", 0), (1, "", 0), (None, "some text here", 14), (2, text, len(text)),
                                           (2, text, len(text))], key=str)
    assert extract(spark, []) == []


def test_small_pages_whole(spark):
    """Every page's article, by an independent pattern for these pages."""
    import html as markup
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()
    want = []
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(markup.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want.append((r.page_id, "\n".join(b for b in blocks if b)))
    assert sorted((i, t) for i, t, _ in extract(spark, [(r.page_id, r.url, r.html) for r in rows])) == sorted(want)
