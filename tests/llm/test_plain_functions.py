"""The functions inside tasks, against brute force; no Spark needed."""

import base64
import itertools
import math
import random
import re

import numpy as np
import pytest

from emberline.llm import byte_bpe, pitman_yor, private_data, quality_rules, secret_scan, weak_labels
from emberline.llm.near_duplicates import Shingler, probability_jaccard, signatures
from emberline.llm.spans import Span, masked
from emberline.llm.text_stats import text_stats

tokenizers_ = pytest.importorskip("public_tokenizers")
BPE = str(tokenizers_.path("byte_bpe_multi_50k.tiktoken"))


def some_texts(signs, number, length, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(signs) for _ in range(pick.randint(0, length))) for _ in range(number)]


def test_bpe_equals_the_tokenizer_and_decodes_back():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    known = tiktoken.Encoding("own", pat_str=tokenizers_.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = some_texts("ab c'sdllve12 \n\t  éßÑ\u3000\x1c\x85中文😀.,!?'t", 3000, 40)
    texts += ["", " ", "a" * 3000, "ab" * 800, "é" * 700, " " * 900, "<|endoftext|>", "the" * 300 + " x"]
    tokenizer = byte_bpe.load(BPE, tokenizers_.PATTERN)
    for units in (None, byte_bpe.UNITS):
        encoder = byte_bpe.Encoder(tokenizer, units, cached=500)
        for run in byte_bpe.batches_of(texts, 4000):
            for text, ids in zip(run, encoder.encode(run)):
                assert ids.tolist() == known.encode_ordinary(text)
                assert byte_bpe.decode(tokenizer, ids) == text.encode()


def plain_private(text):
    """The definitions, written down directly."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        odd, even = digits[-1::-2], digits[-2::-2]
        total = sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m))
    order = ["email", "ip", "card", "phone"]
    found = [Span(m.start(), kind, m.end()) for kind, m in out]
    return sorted(found, key=lambda s: (s.start, order.index(s.kind)))


@pytest.mark.parametrize("signs", ["ab@.-+_", "0123.", "01 -", "+12 ().-", "a1@.+ -", "4 1é-"])
def test_plain_private_spans(signs):
    for text in some_texts(signs, 2500, 45):
        assert private_data.base_spans(text) == plain_private(text), text
        base, spans = private_data.find(text)
        assert set(base) <= set(spans)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("x [at] y [dot] org", "email", "x [at] y [dot] org"),
        ("ann(at)mail.example.org!", "email", "ann(at)mail.example.org"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("host one two seven dot zero dot zero dot one up", "ip", "one two seven dot zero dot zero dot one"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
        ("card ４１１１１１１１１１１１１１１１ x", "card", "４１１１１１１１１１１１１１１１"),
        ("é 4111 one one one one 11111111 é", "card", "4111 one one one one 11111111"),
    ],
)
def test_disguised_spans_are_source_offsets(text, kind, part):
    base, spans = private_data.find(text)
    assert not base
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [(kind, part)]


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("host 192 dot 168 dot one dot one up", "ip", "192 dot 168 dot one dot one"),
        ("call plus 44 triple five triple seven double two 1 ok", "phone", "plus 44 triple five triple seven double two 1"),
        ("+49 30 12345 six seven", "phone", "+49 30 12345 six seven"),
        ("ring plus 44 20 7946 0958", "phone", "plus 44 20 7946 0958"),
        ("«plus 44 20 7946 0958»", "phone", "plus 44 20 7946 0958"),
        ("juan[arroba]ejemplo.com", "email", "juan[arroba]ejemplo.com"),
        ("juan (arobase) exemple.fr", "email", "juan (arobase) exemple.fr"),
        ("jane <@> example.com", "email", "jane <@> example.com"),
        ("jane [\tat] example.com", "email", "jane [\tat] example.com"),
        ("card ４１１１１１１１１１１１１１１１ one of two", "card", "４１１１１１１１１１１１１１１１"),
        ("one of two: 4111 one 11111111111", "card", "4111 one 11111111111"),
    ],
)
def test_disguises_are_read_wherever_one_occurs(text, kind, part):
    base, spans = private_data.find(text)
    assert not base
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [(kind, part)]
    assert masked(text, spans) == text.replace(part, f"<{kind.upper()}>")


def test_dotted_capitals_are_read():
    text = "host 10.0.0.nİne up"
    assert [text[s.start : s.end] for s in private_data.find(text)[1]] == ["10.0.0.nİne"]


def test_transducers_are_left_out_only_without_effect():
    parts = ["at", "dot", "[", "]", "<", ">", " ", "\t", "@", ".", "x", "ann", "org", "1", "92", "one", "plus", "double", "-", "«", "Arroba", "PUNTO", "ſix"]
    pick = random.Random(8)
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        reading = private_data.Reading.of(text)
        if not private_data.has_digit_words(text):
            assert private_data.spoken_digits(reading).text == text
        if not private_data.has_said_signs(text):
            assert private_data.spoken_signs(reading).text == text


def test_clean_prose_is_left_alone():
    for text in [
        "Meet at noon. Dot the i at home, at one.", "It came at last; the dot is small.", "one of the two", "", "plus one",
        "see us at example.com today", "one two three four five six seven eight nine ten", "Das ist um acht, neun oder zwei.",
        "в начале было слово",
    ]:
        assert private_data.find(text) == ([], [])


def test_masked():
    text = "a b@c.de 1.2.3.4 z"
    assert masked(text, private_data.find(text)[1]) == "a <EMAIL> <IP> z"
    assert masked("abcdef", [Span(1, "x", 4), Span(2, "y", 6)]) == "a<X>"


def plain_secrets(text):
    out = [
        ("assign", m)
        for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A
        )
        if len(m.group(2)) >= 12
    ]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    found = [Span(m.start(), kind, m.end()) for kind, m in out]
    return sorted(found, key=lambda s: (s.start, secret_scan.KINDS.index(s.kind)))


def test_plain_secret_spans():
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ": ", '"', "a0", "deadbeef", "AKIA", "XY12Z", " ", "q", "ſecret", "\n"]
    pick = random.Random(5)
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        base, spans = secret_scan.find(text, {})
        assert base == plain_secrets(text), text
        assert set(base) <= set(spans)


def test_guess_cost_is_the_cheapest_cut():
    ranks = {"pass": 2, "word": 3, "password": 1, "sun": 50}

    def segment(value, part):
        low = part.lower()
        offers = [sum(map(secret_scan.brute_force, part))]
        if low in ranks and len(low) >= 3:
            offers.append(math.log10(ranks[low] + 1) + (math.log10(4) if low != part else 0))
        if len(part) >= 3 and len(set(low)) == 1:
            offers.append(math.log10(36 * len(part)))
        return min(offers)

    def brute(value):
        best = math.inf
        for cuts in itertools.product([0, 1], repeat=len(value) - 1):
            parts, start = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(value[start:i])
                    start = i
            parts.append(value[start:])
            best = min(best, sum(segment(value, p) for p in parts) + secret_scan.PER_SEGMENT * len(parts))
        return best

    for value in ["password", "xpassword", "sunzzzz", "Passsun", "q7sunq", "wordword", "x!vkz"]:
        # a cut may be free where brute force follows another segment
        assert secret_scan.guess_cost(value, ranks) <= brute(value) + 1e-9
    assert secret_scan.guess_cost("password", ranks) < 2 < secret_scan.guess_cost("x9$kQ2!vLp7z", ranks)
    assert secret_scan.is_secret("x9$kQ2!vLp7z", ranks) and not secret_scan.is_secret("well-known-word", ranks)


def test_guessed_spans():
    text = "my pwd: x9$kQ2!vLp7z, and the password is required, token of words."
    base, spans = secret_scan.find(text, {"required": 9})
    assert not base and [text[s.start : s.end] for s in spans] == ["x9$kQ2!vLp7z"]


@pytest.mark.parametrize(
    "text",
    [
        "bearer token: {}", "the secret token is {}", "credentials password: {}", "token: Bearer {}", "password:\t{}",
        "pwd\t=\t{}", "token token token {}", "passwort ist {}", "password is: {}", "token := {}", "secret token:{}", "{} token {}",
    ],
)
def test_every_context_word_is_looked_at(text):
    value = "x9$kQ2!vLp7z"
    text = text.replace("{}", value)
    assert [text[s.start : s.end] for s in secret_scan.find(text, {})[1]] == [value]


@pytest.mark.parametrize(
    "text, value",
    [
        ("pwd: xkqzvbwpjhtmrgnl", "xkqzvbwpjhtmrgnl"), ("passphrase: kqzvbwpj-xhtmrgnl", "kqzvbwpj-xhtmrgnl"),
        ("bearer qhZKvbXwplMT", "qhZKvbXwplMT"), ("token: xKqPzVbnMwL", "xKqPzVbnMwL"),
    ],
)
def test_letters_are_priced(text, value):
    assert [text[s.start : s.end] for s in secret_scan.find(text, {})[1]] == [value]


def test_words_are_cheap_by_their_ranks():
    ranks = {word: 5000 for word in ("authentication", "required", "description", "protected")}
    for text in ["password: required", "pwd: authentication-required", "bearer authentication", "token description", "passwd = isProtected"]:
        assert secret_scan.find(text, ranks)[1] == [], text


def test_guess_cost_within_a_limit():
    ranks = {"xxx": 24, "word": 30, "abc": 40}
    for value in some_texts("xw0ord1abc!qeW", 1500, 25) + ["x" * 40, "abcdefghij" * 3, "wordxxxxxxword", "qwertyqwerty"]:
        whole = secret_scan.guess_cost(value, ranks)
        assert secret_scan.guess_cost(value, ranks, 10.0) == (whole if whole < 10 else math.inf)
    assert secret_scan.guess_cost("x" * 20_000, ranks, 10.0) < 10


def test_announced_values_are_not_learnt():
    text = "pwd: xkqzvbwpj, token = abcdefg and the token economy; Bearer qhZKvbX, word"
    assert secret_scan.without_values(text) == "pwd: , token =  and the token economy; Bearer , word"


@pytest.mark.parametrize(
    "text, value",
    [
        ('pwd = "x9;kQ2(vLp7z)!"', "x9;kQ2(vLp7z)!"), ("password: Tr0ub;dor&3x", "Tr0ub;dor&3x"),
        ("pwd: 'x9 kQ2\"vLp7z' is it", 'x9 kQ2"vLp7z'), ('{"password": "x9,kQ2\\"vLp7z", "a": 1}', 'x9,kQ2\\"vLp7z'),
        ("(pwd: x9<kQ2(v)Lp7z).", "x9<kQ2(v)Lp7z"), ("the token (x9$kQ2!vLp7z), then", "x9$kQ2!vLp7z"),
        ("<td>pwd: x9$kQ2!vLp7z</td>", "x9$kQ2!vLp7z"), ("pwd=x9$kQ2!vLp7z;server=database1", "x9$kQ2!vLp7z"),
        ("pwd: \"x9$kQ2!vLp7z\nand more", "x9$kQ2!vLp7z"),
    ],
)
def test_values_are_read_whole(text, value):
    assert [text[s.start : s.end] for s in secret_scan.find(text, {})[1]] == [value]


def test_code_and_prose_with_marks_are_cheap():
    ranks = {word: 900 for word in ("request", "tokenizer", "description", "sentence", "server", "database", "changeme")}
    for text in [
        "token = get(request)", 'the token "a description; a sentence, of 1984 words" and', "pwd=changeme;server=database", "token: <your-token>",
        'password: "', "password: ()", "password: \"\"", "pwd: ''", "token </td>",
    ]:
        assert secret_scan.find(text, ranks)[1] == [], text


def test_tails_of_plain_findings_are_covered():
    text = "password: Abcdef123456;x9$kQ and token = 0123456789abcdef"
    base, spans = secret_scan.find(text, {})
    assert [text[s.start : s.end] for s in base][0] == "password: Abcdef123456"
    assert [text[s.start : s.end] for s in spans if s.kind == "guess"] == ["Abcdef123456;x9$kQ"]


def test_long_values_take_time_in_proportion():
    for mark in ("!", ")", ">", "</b>", "(", "x", "a!", ";a="):
        secret_scan.find("token: x" + mark * 20_000, {})


def plain_stats(text):
    words = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, window in enumerate(windows) if windows.count(window) > 1 for k in range(3)}
    lines, seen, copies = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, copies, len(again)


def test_text_stats():
    for text in [*some_texts("ab \n", 1500, 60), *some_texts("aé|# \t\x0b\u00a0\x85\n", 1500, 40), "", "a a a a", "a b c a b c"]:
        assert text_stats(text)[:5] == plain_stats(text), repr(text)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    accuracy, speaks = [0.95, 0.9, 0.8, 0.7], [0.9, 0.5, 0.8, 0.7]
    votes = np.zeros((len(truth), 4), dtype=int)
    for rule in range(4):
        right = rng.random(len(truth)) < accuracy[rule]
        vote = np.where(right == truth, weak_labels.GOOD, weak_labels.BAD)
        votes[:, rule] = np.where(rng.random(len(truth)) < speaks[rule], vote, weak_labels.ABSTAIN)
    codes, counts = np.unique([weak_labels.pattern(list(row)) for row in votes], return_counts=True)
    model = weak_labels.fit_patterns(codes, counts, 4)
    assert np.allclose(model.accuracies, accuracy, atol=0.06)
    assert ((model.posterior_good(votes) > 0.5) == truth).mean() > 0.93


def test_rules_keep_prose_and_reject_junk():
    prose = " ".join(f"word{i} and some{i}ly text{i % 9}," for i in range(40))
    assert set(quality_rules.votes(text_stats(prose))) <= {weak_labels.GOOD, weak_labels.ABSTAIN}
    assert weak_labels.BAD in quality_rules.votes(text_stats("buy%%% now### " * 40))
    assert quality_rules.votes(text_stats("")) == [weak_labels.ABSTAIN] * quality_rules.N_RULES


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    bags = []
    for shift in (0, 0, 30, 60):
        names = np.arange(shift, shift + 200).astype(np.uint64) * np.uint64(977)
        bags.append((names, rng.integers(1, 5, 200)))
    bags[1] = (bags[0][0], bags[0][1].copy())

    def plain(a, b):
        x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
        every = set(x) | set(y)
        return sum(1 / sum(max(x.get(o, 0) / x[k], y.get(o, 0) / y[k]) for o in every) for k in set(x) & set(y))

    rows = signatures(bags, 2048)
    for i, j in itertools.combinations(range(len(bags)), 2):
        exact = probability_jaccard(bags[i], bags[j])
        assert exact == pytest.approx(plain(bags[i], bags[j]))
        assert (rows[i] == rows[j]).mean() == pytest.approx(exact, abs=0.05)


def test_shingles():
    shingle = Shingler()
    assert len(shingle("")[0]) == 0 and len(shingle("a b")[0]) == 1
    hashes, counts = shingle("a b c d e A b c d e")
    assert counts.sum() == 6 and counts.max() == 2


def test_tables_follow_the_seating_distribution():
    """Against all ways to seat the customers of one dish."""
    discount, strength, base, others, c = 0.6, 1.0, 0.2, 3.0, 4

    def seatings(n):
        if n == 0:
            yield []
            return
        for tables in seatings(n - 1):
            for i in range(len(tables)):
                yield [*tables[:i], tables[i] + 1, *tables[i + 1 :]]
            yield [*tables, 1]

    weights = np.zeros(c + 1)
    for tables in seatings(c):
        weight = math.prod((strength + discount * (others + k)) * base for k in range(len(tables)))
        weights[len(tables)] += weight * math.prod(math.prod(j - discount for j in range(1, size)) for size in tables)
    rng = np.random.default_rng(4)
    n = 40_000
    drawn = pitman_yor.draw_tables(
        np.full(n, c), np.full(n, base), np.full(n, others), strength, discount, rng
    )
    assert np.allclose(np.bincount(drawn, minlength=c + 1) / n, weights / weights.sum(), atol=0.01)
    large = pitman_yor.draw_tables(np.full(200, 5000), np.full(200, 0.01), np.full(200, 9.0), strength, discount, rng)
    assert large.min() >= 1 and large.max() < 5000


def test_packed_ids():
    ids = np.array([5, 9, 2**47, 3, 2**48 - 1, 0], dtype=np.uint64)
    assert pitman_yor.unpacked_ids(pitman_yor.packed_ids(ids)).tolist() == ids.tolist()
    assert pitman_yor.unpacked_ids(pitman_yor.packed_ids(ids[:0])).tolist() == []
