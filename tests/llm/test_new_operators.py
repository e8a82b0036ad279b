"""Token counts against the library, fill-in-middle against a plain form, conversation repair against exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from strandline.llm import dialogs, middle, tokens

from .test_text_operators import ODD, docs_of, odd_texts

# ---- token counts


def library_of(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def long_texts():
    rnd = random.Random(11)
    bits = ["the ", "don't", "'ll", " ", "  ", "\n\n", "\t ", "<|endoftext|>", "<|endof", "é", "🙂", "日本語", "12", "...", "'", "word", " x", "a" * 30, " " * 30]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120))) for _ in range(150)] + ["a" * 3000, " " * 900, "ab " * 700, "x" * 200 + " y" * 200]


@pytest.mark.parametrize("step,overlap", [(tokens.STEP, tokens.OVERLAP), (40, 24), (200, 20)])
def test_counts_equal_the_library(spark, step, overlap):
    import public_tokenizers

    path = public_tokenizers.path(tokens.MODEL)
    library = library_of(path)
    texts = [*ODD, *odd_texts(3, 150), *long_texts(), long_texts()[3], long_texts()[3]]
    got = {r.doc_id: r for r in tokens.count_tokens(docs_of(spark, texts), path, step, overlap).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))), repr(t)[:80]
    assert tokens.count_tokens(docs_of(spark, []), path, step, overlap).count() == 0


def test_seams_are_found_and_overlaps_widen(spark):
    import public_tokenizers

    path = public_tokenizers.path(tokens.MODEL)
    rows = spark.createDataFrame([("plain", "ab cde. " * 60), ("word", "a" * 400 + " b")], "key string, text string")
    first = {r.key: r.n_tokens for r in tokens.spliced(rows, path, 60, 24).collect()}
    assert first["plain"] == len(library_of(path).encode("ab cde. " * 60)) and first["word"] is None
    assert {r.key: r.n_tokens for r in tokens.spliced(rows, path, 600, 100).collect()}["word"] == len(library_of(path).encode("a" * 400 + " b"))


def test_other_models_and_rows_that_repeat(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    texts = ["Some Text here", None, "", "x" * 500]
    rows = docs_of(spark, texts).union(docs_of(spark, texts)).selectExpr("if(text is null, null, doc_id) as doc_id", "text", "lang as n_tokens", "source as key")
    for name, count in (("word_bpe_49k.json", lambda t: len(library_of(public_tokenizers.path("word_bpe_49k.json")).encode(t, add_special_tokens=False))),
                        ("piece_bpe_32k.model", lambda t: len(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode(t)))):
        got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens) for r in tokens.count_tokens(rows, public_tokenizers.path(name)).collect() if r.doc_id is not None)
        assert got == sorted((True, i, count(t)) for i, t in enumerate(texts) if t is not None for _ in range(2))
    monkeypatch.setattr(tokens, "TABLE_WORDS", 2)  # an emptied table changes nothing
    own = tokens.Encoder(public_tokenizers.path(tokens.MODEL))
    for t in ["a b c d e", "b  c <|endoftext|> d", "e f"]:
        assert own.count([t]) == [len(own.library.encode(t, add_special_tokens=False))]


# ---- fill in middle


def plain_fim(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_form_and_restores(spark):
    texts = [*ODD, *odd_texts(5, 300), "a <P> b", "<S>", "x<M>", "< P > <", "a <", "<S <", "\x1c    b"]
    rows = docs_of(spark, texts).withColumnRenamed("lang", "output").withColumnRenamed("source", "form")
    out = middle.fill_in_middle(rows)
    got = {r.doc_id: r for r in middle.restore_texts(out).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(i, t), repr(t)
        assert r.output_sha256 == sha(r.output) and r.restored == (t or "") and r.restored_sha256 == sha(t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs_of(spark, [])).count() == 0
    twice = rows.selectExpr("cast(null as bigint) as doc_id", "text").where("text = 'a '")
    assert {r.output for r in middle.fill_in_middle(twice.union(twice)).collect()} == {plain_fim(None, "a ")[4]}


def test_piece_tables_cut_and_permute():
    text = "αβ γ δ".encode()
    for a, b in itertools.combinations_with_replacement(range(len(text) + 1), 2):
        own = middle.PieceTable(text)
        own.cut(a)
        own.cut(b)
        assert [bytes(x) for x in own.spans()] == [text[:a], text[a:b], text[b:]]
        for form, order in middle.ORDER.items():
            arranged = own.arranged(order)
            assert arranged.restored(order).pieces == own.pieces
            assert middle.restore(arranged.to_bytes(), form).to_bytes() == text
    for broken in (b"<P>ab<S>", b"x<P><S><M>", b""):
        with pytest.raises(ValueError):
            middle.restore(broken, "psm")


# ---- conversations


def fits(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def search(codes):
    """All edit strings that cost no more than deleting everything."""
    n = len(codes)
    best = 2 * n, "D" * n

    def walk(i, cost, audit, roles):
        nonlocal best
        if cost > best[0]:
            return
        if i == n and fits("".join(roles)):
            best = min(best, (cost, audit))
        for r in "ua":
            walk(i, cost + 5, audit + "I", [*roles, r])
        if i < n:
            walk(i + 1, cost + 2, audit + "D", roles)
            c = codes[i]
            if c != "x":
                late = 5 if c in "SUA+" else 0
                walk(i + 1, cost + late, audit + "K", [*roles, c.lower()])
                for r in "ua":
                    walk(i + 1, cost + late + 1, audit + "R", [*roles, r])

    walk(0, 0, "", [])
    return best


def test_solver_equals_exhaustive_search():
    for n in range(4):
        for codes in itertools.product("suaUA-+x", repeat=n):
            assert dialogs.solve("".join(codes)) == search(codes), codes
    rnd = random.Random(4)
    for _ in range(40):
        codes = "".join(rnd.choice("suaUA-x") for _ in range(5))
        assert dialogs.solve(codes) == search(codes), codes


def test_segments_chain_to_the_whole():
    rnd = random.Random(9)
    for n in (0, 1, 7, 40, 120):
        codes = "".join(rnd.choice("suauauaUA-x") for _ in range(n))
        for size in (1, 3, 16):
            chain = dialogs.Chain()
            for i in range(0, n, size):
                chain.add(dialogs.transitions(codes[i : i + size]))
            assert chain.end() == dialogs.solve(codes)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, n int, digest string"


def plain_repair(rows):
    """All results from rows (conv_id, turn, role, text), by plain loops; rows of a turn by digest."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text), "user" if d == 4 else role
        groups.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(d, 1))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]))
        seen, codes, faults = set(), "", [0, 0, 0]
        for _, role, text in own:
            tail, initial = text.rstrip(" \t\n\x0b\x0c\r"), role[:1] if role[:1] in ("s", "u", "a") else "-"
            fault = 0 if not tail else 1 if (role, text) in seen else 2 if tail[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            codes += "x" if fault in (0, 1) else initial if fault is None else "+" if initial == "-" else initial.upper()
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = dialogs.solve(codes)
        left, lines, last = list(own), [], None
        for edit in audit:
            row = None if edit == "I" else left.pop(0)
            if edit != "D":
                role = row[1] if edit == "K" else "user" if last in (None, "s", "a") else "assistant"
                lines.append(f"{role}:{row[2] if row else ''}")
                last = role[:1]
        assert fits("".join(x[0] for x in lines))
        initials = [r[1][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation_rows():
    rnd = random.Random(13)
    say = lambda: rnd.choice(["Hi.", "What is it?", "It is so", " ", "", None, "Yes!\n", "Über alles. \t", "a.b"])
    rows = []
    for conv in range(120):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ["user", "assistant"][turn % 2]
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None]), rnd.choice([role] * 8 + ["system", "tool", "", None]), say() if rnd.random() < 0.4 else f"Turn {conv} {turn}{rnd.choice(['.', '.', ''])}"))
    rows += rows[:30]
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (None, None, None, None)]
    rows += [(500, t, ["user", "assistant"][t % 2] if t % 11 else "user", f"Long {t}." if t % 7 else "Again.") for t in range(700)]  # one long conversation
    rows += [(501, 3, "user", "Same.")] * 90
    dropped = [t for t in range(400) if zlib.crc32(f"502:{t}".encode()) % 20 == 0]
    return rows + [(502, t, "user", "Gone.") for t in dropped[:3]]


@pytest.mark.parametrize("segment", [dialogs.SEGMENT, 7])
def test_repair_equals_plain_loops(spark, segment):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], CONVERSATIONS)
    found = dialogs.repair(dialogs.damaged(frame.repartition(5)), segment).collect()
    got, expected = {r.conv_id: tuple(r)[1:] for r in found}, plain_repair(rows)
    assert len(found) == len(got) == len(expected)
    for conv, row in expected.items():
        assert got[conv] == row, (conv, got[conv], row)
    assert got[502] == (0, 0, 0, 0, 0, 0, "", dialogs.EMPTY)
    assert dialogs.repair(dialogs.damaged(frame.limit(0)), segment).count() == 0
