import re

from helpers import documents, empty, odd_rows, plain, table, with_clashing

from retailcast.llm.licences import PHRASES, TEMPLATES, Automaton, licence_report, licence_spans, scan_text, words_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    own, places = words(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places}))


def test_base_equals_brute_force(spark):
    docs = table(spark)
    got = {r.doc_id: r for r in licence_report(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_overlapping_phrases_and_unicode():
    text = "CC-BY cc by CCK by. General  public; LICENSE general public license All rights reservedé all rights reserved cc"
    n, spans = scan_text(text)
    base = [(s[1], s[0]) for s in spans if s[4]]
    assert n == len(words(text)) and len(base) == brute(text)[1]
    assert [w.decode() for w in words_of(text)] == words(text)


def test_templates_are_found_whole_and_nearly_whole():
    for label, template in TEMPLATES:
        tokens = template.split()
        assert label in {s[0] for s in scan_text("so begins it " + template.upper() + " the rest")[1]}
        if len(tokens) > 12:
            damaged = [*tokens[:8], "altered", *tokens[9:]]
            assert label in {s[0] for s in scan_text(" ".join(damaged))[1]}
            assert label not in {s[0] for s in scan_text(" ".join(tokens[: len(tokens) // 3]))[1] if not s[4]}


def test_automaton_knows_all_substrings():
    texts = [words_of("a b a b c a b"), words_of("b c b c a"), words_of("a a a")]
    auto = Automaton(texts)
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                state = 0
                for w in t[i:j]:
                    state = auto.next[state][auto.ids[w]]
                want = sorted((n, k + j - i - 1) for n, u in enumerate(texts) for k in range(len(u)) if u[k : k + j - i] == t[i:j])
                assert auto.ends[state] == want


def test_odd_rows(spark):
    docs = with_clashing(odd_rows(spark))
    got = plain(licence_report(docs).select("doc_id", "n_words", "n_base"))
    assert got == sorted([(r.doc_id, len(words(r.text)), 0) for r in docs.collect()], key=repr)
    assert licence_report(empty(spark)).count() == 0
    many = licence_spans(documents(spark, "all rights reserved " * 20_000)).first()
    assert len([s for s in many.spans if s.phrase]) == 20_000
