"""Random small inputs against brute force, without Spark."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import decontaminate, line_dedup, secrets, simhash

from . import brute

WORDS = st.lists(st.sampled_from("abc"), max_size=24)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=5), WORDS, st.integers(1, 5))
def test_automaton(items, doc, window):
    names = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    got = decontaminate.Automaton([(n, t.encode().split()) for n, t in names], window)
    spans, found, longest = got.scan([w.encode() for w in doc])
    grams = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert longest == max((j - i for i in range(len(doc)) for j in range(i + 1, len(doc) + 1) if tuple(doc[i:j]) in grams), default=0)
    want = brute.decontaminate([(0, " ".join(doc))], names, window)[0]
    assert sum(e - s for s, e in spans) == want[2] and len(found) == want[3]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=6), max_size=400), st.integers(1, 5))
def test_fingerprint(words, width):
    text = " ".join(words)
    assert simhash.fingerprint(text.encode(), width) == brute.fingerprint(text, width)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("AKIApasswdtoken=: 'secret_0123456789abcdef\n.é"), max_size=120))
def test_base_spans(text):
    spans = secrets.base_spans(text)
    assert secrets._named(spans) == brute.secrets(text)[4]
    linked = secrets.linked_spans(text, spans)
    assert all(text[s:e] for s, _, e in linked)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_line_key(line):
    line = line.replace("\n", " ")
    key = brute.lower(line.strip(brute.BLANKS))
    assert line_dedup.line_key(line.encode()) == (key.encode() if len(key) >= 10 else None)


def test_linking_needs_all_parts():
    whole = "user = alice\npassword = 'a!b#'\nhost = db.example.com\n"
    spans = secrets.linked_spans(whole, secrets.base_spans(whole))
    assert [whole[s:e] for s, _, e in spans] == ["a!b#'"]
    for gone in ("user = alice\n", "host = db.example.com\n"):
        part = whole.replace(gone, "")
        assert secrets.linked_spans(part, secrets.base_spans(part)) == []
    far = whole.replace("host", "\n\nhost")
    assert secrets.linked_spans(far, secrets.base_spans(far)) == []
    url = "postgres://bob:pw1@db.example.com/x"
    assert [url[s:e] for s, _, e in secrets.linked_spans(url, [])] == ["pw1"]
