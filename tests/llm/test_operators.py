"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from html import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import audio, chat, graph, html, langid, minhash, mixing, packing, quality, secrets, tokens
from weftgraph.llm.common import cut, word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, parts=3):
    """Rows (doc_id, text[, lang[, source]]) with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "k", "l", 7) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


ODD = [(901, None), (902, ""), (903, "   \n\t"), (904, "x"), (905, "é ü 漢字 \U0001f600 " * 40), (906, "long " * 60_000), (907, "no\u00a0break\x1cfs"), (908, "same text here"), (908, "same text here"), (None, "without id")]


# ---- mixing

def mixed_rows(spark, df):
    m = mixing.mix(df.drop("size"), word_count(df.text))
    return m.select("doc_id", "source", "__wg_size", "__wg_source_size", "__wg_target", "__wg_taken", "__wg_at").collect()


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 200)), "en", rng.choice(["a"] * 12 + ["b", "c", "d", None])) for i in range(900)] + [(r[0], r[1], "en", "a") for r in ODD]
    df = docs(spark, rows)
    got = mixed_rows(spark, df)
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in full)
        free -= full
    took = Counter()
    for r in got:
        assert r["__wg_source_size"] == size[r["source"]] and r["__wg_target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["__wg_taken"] <= 2 * r["__wg_size"] and all(0 <= t <= 1 for t in r["__wg_at"])
        took[r["source"]] += r["__wg_taken"]
    assert all(abs(took[s] - target[s]) <= 1 for s in order)
    again = {(r.doc_id, r["__wg_taken"], tuple(r["__wg_at"])) for r in mixed_rows(spark, docs(spark, rows, 5))}
    assert again == {(r.doc_id, r["__wg_taken"], tuple(r["__wg_at"])) for r in got}


def test_many_rows_of_one_id(spark):
    """Null ids and equal rows in great number: cells stay small, and the mix is the same."""
    rng = random.Random(62)
    rows = [(None, words(rng, 10), "en", "a") for _ in range(400)] + [(7, "one two three", "en", "a")] * 300 + [(i, words(rng, 12), "en", "b") for i in range(1000, 1300)]
    df = docs(spark, rows).drop("size")
    few = mixing.mix(df, word_count(df.text), cell_rows=5)
    many = mixing.mix(df, word_count(df.text), cell_rows=100_000)
    for m in (few, many):
        got = m.collect()
        assert len(got) == len(rows)
        for s in "ab":
            own = [r for r in got if r.source == s]
            assert abs(sum(r["__wg_taken"] for r in own) - own[0]["__wg_target"]) <= 1
    # The most rows of a cell, as it is dealt for the running sums.
    assert few.select("doc_id", "__wg_at").count() == len(rows)
    again = sorted((str(r.doc_id), r["__wg_taken"]) for r in mixing.mix(df, word_count(df.text), cell_rows=5).collect())
    assert again == sorted((str(r.doc_id), r["__wg_taken"]) for r in few.collect())


def test_curriculum_follows_its_curve(spark):
    rng = random.Random(2)
    df = docs(spark, [(i, words(rng, 20), "en", s) for i in range(400) for s in ["a"]] + [(1000 + i, words(rng, 20), "en", "b") for i in range(400)])
    at = {s: sorted(t for r in mixed_rows(spark, df) if r.source == s for t in r["__wg_at"]) for s in "ab"}
    # a falls from 6.5 to 3.5, b rises from 1 to 3: shares of the first half.
    assert sum(t < 0.5 for t in at["a"]) / len(at["a"]) == pytest.approx(0.575, abs=0.01)
    assert sum(t < 0.5 for t in at["b"]) / len(at["b"]) == pytest.approx(0.375, abs=0.01)


def test_training_order_keeps_columns(spark):
    rng = random.Random(3)
    df = docs(spark, [(i, words(rng, 30), "en", "ab"[i % 2]) for i in range(60)])
    out = mixing.training_order(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    assert mixing.training_order(df.limit(0)).collect() == []


# ---- chat

def test_chat_reads_back(spark):
    rng = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 25)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice([None, "", words(rng, rng.randrange(200)), "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nhi \\<\\|", "\\n\n\\"]), "x"))
    rows += [(70, t, "system" if t < 2 else "user", f"{t} " + "word " * (300 if t < 2 else 40), "x") for t in range(60)]
    rows += [(77, 0, "user", "long " * 3000, "x"), (77, 1, "assistant", "y " * 3000, "x"), (78, 0, None, "r", "x"), (None, 0, "assistant", "z", "x"), (79, 1, "assistant", "b", "x"), (79, 1, "assistant", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(df)
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back.keys() == by.keys()
    for c, turns in by.items():
        assert back[c].n_turns == len(turns)
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    wins = made.collect()
    assert sum(len(w.text) for w in wins) == sum(r.formatted_chars for r in back.values())
    many = [w for w in wins if w.window > 0]
    assert many and all(w.n_tokens <= chat.BUDGET or sum(new for new, *_ in chat.parse(w.text)) == 1 for w in wins)
    ids = tokens.encoder(tokens.vocabulary_path())
    assert all(w.n_tokens == len(ids.whole(w.text)) // 4 for w in wins)  # of the window as a whole
    for w in many:
        lead = [t for t in by[w.conv_id]]
        lead = lead[: next((i for i, t in enumerate(lead) if t[0] != "system"), len(lead))]
        assert [t[1:] for t in chat.parse(w.text)[: len(lead)]] == lead
    past = [sum(not new for new, *_ in chat.parse(w.text)) for w in many]
    assert max(past) > 2
    assert chat.read_back(chat.windows(df.limit(0))).collect() == []


# ---- packing

def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(0, 900), 5000)) for i in range(150)] + [r for r in ODD if r[0] != 908] + [(910, "a  b\n\n c \n"), (911, "<|endoftext|> hi"), (912, " lead"), (913, "tab\t\tx\u2003y"), (914, "1234567 'll don't")]
    df = docs(spark, rows)
    pieces = packing.pack(df).collect()
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    got, seqs = {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert got.keys() == want.keys()
    for i, ps in got.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            ids = np.array(want[i][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids.tobytes()) and p.doc_tokens == len(want[i])
            at += p.length
        assert at == len(want[i])
    full = Counter()
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        full[at in packing.TIERS] += 1
        assert at in packing.TIERS or at < min(packing.TIERS) and ps[0].tier == 1024
    assert full[False] <= df.rdd.getNumPartitions()  # one padded sequence a task at most
    assert packing.pack(df.limit(0)).collect() == []
    assert {p.doc_id for p in packing.pack(docs(spark, rows[:2]).repartition(7)).collect()} == {0, 1}


def test_step_groups_are_full():
    rng = random.Random(51)
    packer = packing.Packer(1024, packing.TIERS, 8192, 0)
    out = []
    for d in range(4000):
        packer.add(d, 0, rng.randrange(1, 3000))
        if d % 500 == 499:
            packer.pack()
            out += packer.drain(False)
    packer.finish()
    out += packer.drain(True)
    size, tier_of, seqs = Counter(), {}, Counter(seq for _, _, seq, _ in out)
    for tier, group, _, pieces in out:
        assert sum(e - s for _, s, e in pieces) == tier or tier == 1024
        size[group] += tier
        assert tier_of.setdefault(group, tier) == tier
    assert max(seqs.values()) == 1
    assert max(Counter(tier_of[g] for g, n in size.items() if n != 8192).values(), default=0) <= 1
    covered = Counter()
    for _, _, _, pieces in out:
        for d, s, e in pieces:
            covered[d] += e - s
    again = random.Random(51)
    assert covered == {d: again.randrange(1, 3000) for d in range(4000)}


# ---- near-duplicates

def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(rng):
    rows, i = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(5, 150), 3000).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            rows.append((i * 7 % 1009, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
            i += 1
    rows += [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "a b"), (2005, " \n")]
    big = words(rng, 80, 3000).split()
    rows += [(3000 + k, " ".join(big[: 70 + k % 11])) for k in range(120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,percent,chunk", [(3, 85, 3000), (5, 80, 3000), (3, 85, 20)])
def test_near_duplicates(spark, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(minhash, "CHUNK_MEMBERS", chunk)
    monkeypatch.setattr(minhash, "HUBS", 4)
    rows = variants(random.Random(6))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows), n, percent).collect()}
    want = brute_components(rows, n, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_texts_of_dissimilar_bucket_mates_are_not_sent(spark, monkeypatch):
    """Half of each text is the same, so buckets chain them all; a few are similar indeed."""
    rng = random.Random(61)
    base = words(rng, 60, 3000)
    rows = [(i, f"{base} {words(rng, 40, 3000)}") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(5)]
    sent = []
    real = minhash._connect

    def spy(placed, signed, texts, n, percent):
        sent.append((texts is not None, placed.select("id").distinct().count()))
        return real(placed, signed, texts, n, percent)

    monkeypatch.setattr(minhash, "_connect", spy)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)
    assert sent[0][0] is False and sent[0][1] > 200 and sent[1] == (True, 10)


def test_one_of_each(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (8, "other words in this text here"), (None, "a b c d e f"), (9, None)]
    df = docs(spark, rows)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 3), (False, 8), (False, 9), (True, 0)]
    assert minhash.one_of_each(df.limit(0)).collect() == []


def test_rounds_of_joins_leave_small_estimates(spark):
    """A path takes many rounds; the number that Spark guesses its size to be must not gain digits in each."""
    ids = spark.range(200).withColumnRenamed("id", "k")
    path = cut(ids.where("k < 199").selectExpr("(k * 91) % 200 AS a", "((k + 1) * 91) % 200 AS b"))
    assert path._jdf.queryExecution().analyzed().stats().sizeInBytes() < 1 << 20
    found = graph.components(path)
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(200)]
    assert found._jdf.queryExecution().analyzed().stats().sizeInBytes() < 1 << 70


def test_cut_keeps_rows_columns_and_later_joins(spark):
    rows = [(k % 7, None if k % 5 == 0 else str(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "a long, b string")
    wide = df.withColumnRenamed("b", "c")
    for _ in range(5):
        wide = wide.join(df.groupBy("a").agg(F.count("*").alias("n")), "a").drop("n")
        wide = cut(wide.union(wide.join(wide.select(F.col("a").alias("x"), F.col("c").alias("y")), F.col("a") == F.col("x")).select("a", "c")).distinct())
    assert sorted(wide.collect(), key=str) == sorted(df.withColumnRenamed("b", "c").distinct().collect(), key=str)
    assert wide.columns == ["a", "c"] and wide.join(wide, "a").count() == sum(n * n for n in Counter(r.a for r in wide.collect()).values())


# ---- language

VOCAB = {"aa": "kalo mira tenu sola vire dako".split(), "bb": "strun grolk brask thrund flonk wrisp".split(), "cc": "xiao ming zhuo qian liu xue".split()}


def test_language_held_out(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.sample(VOCAB[lang], 2))[:9] for _ in range(rng.randrange(3, 60))), lang) for i in range(900) for lang in [rng.choice(list(VOCAB))]]
    rows += [(5000, None, "aa"), (5001, "123 !?", "aa"), (5002, "", None), (5003, "kalo mira tenu sola", None), (None, "kalo mira tenu", "aa")]
    df = docs(spark, rows)
    got = langid.identify(df, langid.learn(df)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[5000] == by[5001] == by[5002] == "und" and by[5003] == "aa"
    assert langid.identify(df.limit(0), langid.learn(df.limit(0))).collect() == []
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


# ---- audio

def test_codecs():
    assert audio.TABLES["mulaw"][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert sorted(set(map(abs, audio.TABLES["alaw"].tolist())))[:3] == [8, 24, 40] and abs(audio.TABLES["alaw"]).max() == 32256
    t = np.arange(4000)
    wave = (8000 * np.sin(t / 9)).astype(np.int16)
    back = audio.decode_adpcm(np.frombuffer(audio.encode_adpcm(wave), np.uint8))[: len(wave), 0]
    assert np.abs(back[200:].astype(int) - wave[200:]).mean() < 400
    # One sample at a time, as the standard says it; in one file with blocks of other sizes and channels.
    rng = np.random.default_rng(1)
    media, wants = [], []
    for block, channels in ((64, 1), (256, 1), (1024, 1), (512, 2), (64, 1)):
        raw = rng.integers(0, 256, block * 5, dtype=np.uint8)
        media.append(audio.wav("ima_adpcm", raw.tobytes() + b"rest", 8000, block, channels))
        want = []
        for b in raw.reshape(-1, block):
            lanes = []
            for c in range(channels):
                now, step = int(b[4 * c : 4 * c + 2].copy().view("<i2")[0]), min(int(b[4 * c + 2]), 88)
                lane = [now]
                own = [b[w + 4 * c + i] for w in range(4 * channels, block, 4 * channels) for i in range(4)]
                for code in (int(v) >> s & 15 for v in own for s in (0, 4)):
                    size = int(audio.STEPS[step])
                    diff = (size >> 3) + (size if code & 4 else 0) + (size >> 1 if code & 2 else 0) + (size >> 2 if code & 1 else 0)
                    now = max(-32768, min(32767, now + (-diff if code & 8 else diff)))
                    step = max(0, min(88, step + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                    lane.append(now)
                lanes.append(lane)
            want += [sum(x) // channels for x in zip(*lanes)]
        wants.append(want)
    assert [pcm.tolist() for _, _, pcm in audio.decode_many(media)] == wants


def test_resampling_keeps_the_tone():
    t = np.arange(8000)
    for rate, to in ((8000, 16000), (11025, 16000), (44100, 16000), (16000, 16000)):
        tone = lambda r, f=700: 9000 * np.sin(2 * np.pi * f * np.arange(r) / r)
        got = audio.resample(tone(rate).astype(np.int16), rate, to)
        assert len(got) == to and np.abs(got[200:-200] - tone(to)[200:-200]).max() < 120
    assert np.abs(audio.resample(tone(44100, 15000).astype(np.int16), 44100, 16000)[200:-200]).max() < 500  # beyond the new rate
    assert len(audio.resample(t[:0].astype(np.int16))) == 0


def test_odd_media(spark):
    good = audio.text_media("hello " * 40)
    odd = [b"", b"RIFF", good[:30], good[:44], good[: len(good) - 70], b"RIFF\0\0\0\0WAVEdata\x08\0\0\0abcdefgh", good.replace(b"fmt ", b"FMT "), audio.wav("pcm", b"\1\2\3", 8000), audio.wav("pcm", b"", 8000)]
    tag = bytearray(audio.wav("mulaw", b"abcd"))
    tag[20] = 99
    df = spark.createDataFrame([(i, bytearray(m), "x") for i, m in enumerate([*odd, bytes(tag)])] + [(50, None, "x")], "k int, media binary, pcm string")
    out = {r.k: r.pcm for r in audio.decode_media(df.repartition(12)).collect()}
    assert len(out) == len(odd) + 2
    assert [out[i] is None for i in (0, 1, 2, 5, 6, 9, 50)] == [True] * 7
    assert len(audio.read_wav(bytes(out[7]))[1]) == 4 and len(audio.read_wav(bytes(out[8]))[1]) == 0 and out[4] is not None


def test_audio_round_trip(spark):
    rows = ODD + [(i, "t" * i) for i in (63, 64, 65, 128)]
    got = audio.media_digests(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = text[r.doc_id].encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = audio.text_media(text[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and bytes(audio.read_wav(media)[1]) == data
    df = spark.createDataFrame([(1, bytearray(audio.text_media("hello"))), (2, None)], "k int, media binary")
    out = {r.k: r.pcm for r in audio.decode_media(df).collect()}
    assert audio.read_wav(bytes(out[1]))[0][:2] == ("pcm", 16000) and out[2] is None
    stored = {r.doc_id: r for r in audio.store_texts(docs(spark, rows)).collect()}
    for r in got:
        if r.doc_id != 908:
            assert (r.pcm_bytes, r.pcm_sha256, r.media_sha256) == (len(stored[r.doc_id].pcm), hashlib.sha256(stored[r.doc_id].pcm).hexdigest(), hashlib.sha256(stored[r.doc_id].media).hexdigest())


# ---- quality

def test_quality_counts(spark):
    rng = random.Random(9)
    rows = ODD + [(i, "\n".join(words(rng, rng.randrange(0, 12), 5) + rng.choice(["", " #*$ <|>", " %&"]) for _ in range(rng.randrange(1, 30)))) for i in range(200)]
    for r in quality.judge(docs(spark, rows), None).collect():
        text = next(t or "" for i, t in rows if i == r.doc_id)
        w = WORD.findall(text)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)), text[:50]
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_trees_learn_and_hold_their_signs():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (rng.random(3000) < 0.05)).astype(int)
    model = quality.fit_trees(x, y)
    score = model.score(x)
    assert ((score > 0) == (x[:, 0] > 0.5)).mean() > 0.93
    for name in quality.MONOTONE:
        f = quality.FEATURES.index(name)
        up = x[:200].copy()
        up[:, f] = np.minimum(1, up[:, f] + 0.3)
        assert (model.score(up) <= model.score(x[:200]) + 1e-12).all()
    assert quality.fit_trees(x, np.ones(3000, int)) is None
    # Scored by the flat arrays as by walking each tree; and both labels of one document on one side.
    for row, got in zip(x[:50], score[:50]):
        total = model.bias
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (row[model.feature[at]] > model.bound[at])
            total += model.value[at]
        assert abs(total - got) < 1e-9
    twice = quality.fit_trees(np.repeat(x[:400], 2, axis=0), np.tile([0, 1], 400), np.repeat(np.arange(400), 2))
    assert abs(twice.score(x)).max() < 0.5  # the labels contradict each other: nothing to learn


def test_good_documents(spark):
    rng = random.Random(10)
    good = [(i, words(rng, 120, 5000)) for i in range(200)]
    bad = [(1000 + i, "#*$ buy!!! " * 4 + words(rng, 100, 30)) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, good + bad + ODD)
    out = quality.good_documents(df, labels)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and len(kept & {i for i, _ in good}) >= 196 and not kept & {i for i, _ in bad}
    assert quality.good_documents(df.limit(0), labels.limit(0)).collect() == []


# ---- secrets

BASE = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute_spans(text):
    out = []
    for o, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), o, kind, m.end()))
    return sorted(out)


def secret_texts():
    rng = random.Random(11)
    bits = ["password=hunter2hunter2", "passwd: 'abc'", 'api_key = "A1b2C3d4E5"', "APIKEY:12345678", "token", "=", " : ", "AKIA" + "Q7" * 8, "AKIA12", "deadbeef" * 5, "0123abc", "secret=secret=abcdefgh", "é", "\U0001f600", "\n", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "words here", "f" * 32, "f" * 31]
    return [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(30)))) for i in range(300)] + ODD


def test_secrets(spark):
    rows = secret_texts()
    got = secrets.digest(secrets.findings_by_path(docs(spark, rows), secrets.scan_unseen(docs(spark, rows)))).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows}
    for r in got:
        want = brute_spans(text[r.doc_id])
        n = Counter(x[2] for x in want)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"]) and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not want or set(joined.split(",")) <= set(r.spans.split(","))
    assert secrets.digest(secrets.findings_by_path(docs(spark, []), secrets.scan_unseen(docs(spark, [])))).collect() == []


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    rows = secret_texts()
    first, both = docs(spark, rows[:100]), docs(spark, rows)
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    ledger.record(first)
    n = spark.read.parquet(str(tmp_path / "ledger/scanned")).count()
    assert secrets.scan_unseen(first, spark.read.parquet(str(tmp_path / "ledger/scanned"))).isEmpty()
    got = {(r.doc_id, str(r.found)) for r in ledger.update(both).collect()}
    assert got == {(r.doc_id, str(r.found)) for r in secrets.findings_by_path(both, secrets.scan_unseen(both)).collect()}
    assert spark.read.parquet(str(tmp_path / "ledger/scanned")).count() > n


def test_redact(spark):
    rows = secret_texts()
    df = docs(spark, rows)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    text = dict(rows)
    for r in out.collect():
        if r.text is not None:
            assert not [s for s in brute_spans(r.text) if "SECRET" not in r.text[s[0] : s[3]]]
            assert r.n_chars == len(r.text)
        if not r.text or "[SECRET]" not in r.text:
            assert r.text == text[r.doc_id]


# ---- pages

def page(rng, i, body):
    nav = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(4))
    return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul>{nav}</ul></nav><div class='cookie-notice'>We use cookies</div><article>{body}<script>var a = '<p>no</p>';</script><aside class=ad>Buy</aside></article><div id='comments'><p>Nice {i}</p></div><form><p>Sign up</p></form><footer>© Us</footer></body></html>"


def test_pages(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(40):
        paras = [words(rng, rng.randrange(3, 40)) + rng.choice(["", " & <b> x", " é", " “q”"]) for _ in range(rng.randrange(1, 5))]
        rows.append((i, f"http://h{i % 2}.org/{i}", page(rng, i, "".join(f"\n<p>{escape(p).replace('é', '&eacute;')}\n</p>" for p in paras))))
        want[i] = " ".join(paras)
    rows += [(100, None, None), (101, "", ""), (102, "http://x.y/", "plain <b>text</b>&nbsp;here"), (103, "bad url", "<p>un<closed"), (104, "http://z/", "<p>" * 3000)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == len(rows) and {i: got[i].text for i in want} == want
    assert got[100].text == got[101].text == got[104].text == "" and got[102].text == "plain text here" and all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df.limit(0)).collect() == []


def test_template_blocks_go(spark):
    """Without an article element, what most pages of a host share is template."""
    rng = random.Random(13)
    rows = [(i, f"http://t.org/{i}", f"<body><div class=x><p>Same line on all pages</p><p>own {words(rng, 20)}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.extract(df).collect():
        assert r.text.startswith("own ") and "Same line" not in r.text
