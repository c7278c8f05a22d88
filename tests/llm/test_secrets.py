import base64
import hashlib
import random
import re
import string
import time


from nearvote.llm.secrets import SecretConfig, find_secrets, redact, secret_digest

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex", "random")


def base(text):
    """(start, kind, end) of the fixed patterns, by their plain definition."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(found)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def tricky(rng):
    pieces = ["password", "PassWd", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "\n", "é", "\U0001f600", "AKIA", "AKIAAKIA", "abc", "0123456789abcdef", "ABCDEF0123", "x.y-z_+/", "deadbeef", "\x00", "."]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60)))


def test_base_spans_equal_the_plain_definition(docs, odd_texts):
    rng = random.Random(1)
    rows = odd_texts + [(100 + i, tricky(rng)) for i in range(400)]
    rows += [(900, "secret=token:abcdefgh12"), (901, "token:token=abcdefgh"), (902, "token=abc"), (903, "a" * 31 + " " + "a" * 32), (904, "AKIA" + "B" * 11 + " AKIA" + "B" * 12)]
    got = {r["doc_id"]: r for r in secret_digest(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest(), t
        kept = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert ",".join(kept) == written(want)


def keys(rng, n, length):
    return ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(length)) for _ in range(n)]


def test_battery_finds_random_tokens_and_leaves_words(docs):
    rng = random.Random(2)
    secrets = keys(rng, 40, 48) + [base64.b64encode(bytes(rng.randrange(256) for _ in range(60))).decode() for _ in range(40)]
    syllables = ["ing", "tion", "keit", "lich", "ment", "heit", "en", "er", "schaft", "ung", "ver"]
    plain = ["".join(rng.choice(syllables) for _ in range(8)) for _ in range(60)]
    plain += ["_" * 40, "-" * 30, "=" * 30, "a" * 50, "abcdefghijklmnopqrstuvwxyzabcdefghij", "0123456789" * 5, "some-long-branch-name-for-the-release", "path/to/some/deeply/nested/source/file", "2024-01-01-2024-02-01-2024-03-01-2024"]
    rows = [(i, f"here is {s} in prose") for i, s in enumerate(secrets)] + [(1000 + i, f"here is {s} in prose") for i, s in enumerate(plain)]
    got = {r["doc_id"]: r["spans"] for r in secret_digest(docs(rows)).collect()}
    found = [i for i in range(len(secrets)) if got[i]]
    assert len(found) >= 0.9 * len(secrets)
    for i in found:
        assert got[i] == f"random:8:{8 + len(secrets[i])}"
    wrong = [s for i, s in enumerate(plain) if "random" in got[1000 + i]]
    assert len(wrong) <= 1, wrong


def test_tokens_inside_fixed_spans_are_not_reported_again(docs):
    key = keys(random.Random(4), 1, 60)[0]
    (r,) = secret_digest(docs([(1, f"token={key}")])).collect()
    assert r["spans"] == f"assign:0:{6 + len(key)}"


def test_length_strata_are_separate(docs):
    rng = random.Random(6)
    long = keys(rng, 1, 200)[0]
    crowd = [(i, "".join(rng.choice("etaoinshr") for _ in range(24))) for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in secret_digest(docs(crowd + [(999, long)])).collect()}
    assert got[999] == "random:0:200"


def test_redaction_keeps_everything_else(docs):
    rows = [(1, "a password=abcdefgh1 b AKIA" + "Q" * 16 + "."), (2, None), (3, "é \U0001f600 token: 0123456789abcdef0123456789abcdef0 end"), (4, ""), (4, "clean")]
    table = docs(rows)
    clean = redact(table)
    assert clean.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str)
    assert got == sorted([(1, "a [secret] b [secret]."), (2, None), (3, "é \U0001f600 [secret] end"), (4, ""), (4, "clean")], key=str)
    assert [r["key"] for r in clean.select("key").distinct().collect()] == ["x"]


def test_a_text_of_many_spans_takes_time_in_proportion(docs):
    """A checksum list, and spans that overlap, against the plain definition."""
    rng = random.Random(8)
    sums = "\n".join(hashlib.md5(str(i).encode()).hexdigest() + f"  é-{i}.bin token=AKIA{'Q' * 16}{i}" for i in range(20_000))
    mixed = " ".join(tricky(rng) for _ in range(300))
    table = docs([(1, sums), (2, mixed)])
    began = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in redact(table).collect()}
    digests = {r["doc_id"]: r for r in secret_digest(table).collect()}
    assert time.perf_counter() - began < 90  # folds over all spans at once took many minutes
    for i, text in ((1, sums), (2, mixed)):
        want = base(text)
        assert digests[i]["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest()
        extra = [(int(a), int(b)) for s in digests[i]["spans"].split(",") if s.startswith("random") for a, b in [s.split(":")[1:]]]
        out, at = [], 0
        for a, b in sorted([(a, b) for a, _, b in want] + extra):
            out.append(text[at:a] + "[secret]" if a >= at else "")
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:]


def test_empty_table(docs):
    assert secret_digest(docs([])).count() == 0 and redact(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = find_secrets(docs([(1, "x")]), SecretConfig())._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
