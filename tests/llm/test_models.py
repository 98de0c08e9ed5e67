"""Subjects, abuse, reading level and text kind: held-out accuracy on the hand labels, and edge rows."""

import os

import duckdb
import numpy as np
import pytest

from textweir.llm import abuse, queries, readlevel, subjects, textkind

SF = "/root/testdata/sf0.1"
EDGE = ["", " \n\t ", "x", "é" * 50_000, "word " * 20_000, "a\tb\nc\td", "日本語のテキスト。", "😀😀", "\u0000￿", "no newline, no end"]


def labelled(aspect):
    rows = duckdb.sql(
        f"""SELECT any_value(text), list_sort(list(DISTINCT lower(trim(answer)))) FROM '{SF}/record_labels.parquet' JOIN '{SF}/refined_commands_filtered.parquet' r USING (record_id)
        WHERE aspect = '{aspect}' AND trim(text) <> '' GROUP BY record_id ORDER BY record_id"""
    ).fetchall()
    return rows[::2], rows[1::2]


def test_text_kind_held_out():
    train, test = labelled("text_kind")
    p = textkind.fit_profiles([(t, a[0]) for t, a in train if len(a) == 1])
    kinds, _ = p.assign(textkind.statistics([t for t, _ in test])[0])
    assert np.mean([k in a for k, (_, a) in zip(kinds, test)]) > 0.95


def test_text_kind_without_labels():
    p = textkind.fit_profiles([])
    texts = ["The dog ran home. It was late, and nobody saw it.", "- red\n- green\n- blue\n- white", "a | 1 | 2\nb | 3 | 4\nc | 5 | 6"]
    assert p.assign(textkind.statistics(texts)[0])[0] == ["prose", "list", "table"]


def test_subjects_held_out():
    train, test = labelled("subject")
    about = duckdb.sql(f"SELECT subject, about FROM '{SF}/subject_areas.parquet'").fetchall()
    m = subjects.fit_subjects(train, about)
    right = [set(s) == set(a) - {"none"} for s, (_, a) in zip(m.assign([t for t, _ in test]), test)]
    # Some 390 labelled texts, of which a few per cent are wrong; 4,000 give 0.95.
    assert np.mean(right) > 0.7


def test_levels_held_out():
    train, test = labelled("reading_level")
    m = readlevel.fit_levels([(t, int(a[0])) for t, a in train if len(a) == 1])
    said = m.levels([t for t, _ in test])
    assert np.mean([str(k) in a for k, (_, a) in zip(said, test)]) > 0.9
    assert np.all(np.diff(m.cuts) > 0)


def test_abuse_held_out():
    train, test = labelled("abuse")
    m = abuse.fit_abuse([(t, a == ["yes"]) for t, a in train if len(a) == 1])
    scores, _ = m.scores([t for t, _ in test])
    said, truth = scores >= m.threshold, np.array([a == ["yes"] for _, a in test])
    # With 20 or so abusive texts to learn from, of which some are mislabelled.
    assert (said & ~truth).sum() <= 0.02 * len(test) and (said & truth).sum() >= 0.5 * truth.sum()


def labelled_abuse(sf):
    return duckdb.sql(
        f"""SELECT any_value(text), min(lower(trim(answer))) FROM '/root/testdata/{sf}/record_labels.parquet' JOIN '/root/testdata/{sf}/refined_commands_filtered.parquet' r USING (record_id)
        WHERE aspect = 'abuse' AND trim(text) <> '' GROUP BY record_id HAVING count(DISTINCT lower(trim(answer))) = 1 ORDER BY record_id"""
    ).fetchall()


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_l"), reason="needs the larger tables")
def test_abuse_held_out_with_many_labels():
    train, test = labelled_abuse("check_l"), labelled_abuse("check_s") + labelled_abuse("sf0.1")
    m = abuse.fit_abuse([x for x in ((t, a == "yes") for t, a in train) if x[1]] + [(t, False) for t, a in train if a == "no"])
    scores, _ = m.scores([t for t, _ in test])
    said, truth = scores >= m.threshold, np.array([a == "yes" for _, a in test])
    # 19 of the 74 labelled abusive have no abusive passage, so 0.74 is all that can be found of them.
    assert (said & ~truth).sum() <= 0.06 * said.sum() and (said & truth).sum() >= 0.7 * truth.sum()


def test_disguises_are_taken_off():
    for raw, bare in (("sh1t", "shit"), ("a$$hole", "asshole"), ("f u c k", "fuck"), ("y.o.u a.r.e a f.u.c.k.i.n.g", "you are a fucking"), ("s h u t  u-p", "shut  u-p"), ("s-h-u-t u.p.s you", "shut ups you"), ("fuuuuck", "fuck"), ("i​diot", "idiot"), ("UD6704", "ud0")):
        assert abuse.undisguised(raw) == bare


def test_disguises_are_sought_where_there_are_traces(monkeypatch):
    given, own = [], abuse.undisguised
    monkeypatch.setattr(abuse, "undisguised", lambda t: given.append(t) or own(t))
    odd = ["sh1t happens", "a$$", "f u c k", "f.u.c.k off", "a 0.0.0 b", "fuuuck", "i\u200bdiot", "no 12", "٣ to 0", "so!", "İi", "x€y", "ok 0 0", "plain words, nothing else", "0", "50", "a_b_c d", "ÿ÷ÿ", "x 😀😀😀 y"]
    windows = odd + [w for t, _ in labelled("abuse")[0] for w in abuse.windows_of(t)]
    assert abuse.undisguised_lines(windows) == [own(w) for w in windows] and abuse.undisguised_lines([]) == []
    # The patterns, which are slow, see few of the windows.
    assert sum(len(t.split("\n")) for t in given) < 0.5 * len(windows)


def test_a_run_of_words_is_compressed_once(monkeypatch):
    train, test = labelled("abuse")
    m = abuse.fit_abuse([(t, a == ["yes"]) for t, a in train if len(a) == 1])
    texts = [t for t, _ in test][:100]
    first, seen, one = m.scores(texts), [], abuse._Compressor._all
    monkeypatch.setattr(abuse._Compressor, "_all", lambda self, x: seen.extend(x) or one(self, x))
    again = m.scores(texts)
    windows = {w.encode() for t in texts for w in abuse.undisguised_lines(abuse.windows_of(t))}
    # The second time only whole windows are compressed, with the same scores.
    assert set(seen) <= windows and (first[0] == again[0]).all() and first[1] == again[1]
    monkeypatch.setattr(abuse, "MOST_KNOWN", 0)
    assert (m.scores(texts)[0] == first[0]).all()


def test_every_window_is_scored():
    train, test = labelled("abuse")
    m = abuse.fit_abuse([(t, a == ["yes"]) for t, a in train if len(a) == 1])
    plain = [w for t, a in test if a == ["no"] for w in abuse.windows_of(t) if 10 <= len(w.split()) <= 16]
    insults = [x for x in abuse.TOXIC_EXAMPLES if len(x.split()) in (4, 5)]
    texts = [" ".join([*w.split()[:5], insults[i % len(insults)], *w.split()[5:]]) for i, w in enumerate(plain)]
    scores, worst = m.scores(texts)
    # Ordinary words around an insult make the whole window nearer to the ordinary dictionary; it must be scored all the same.
    assert len(texts) > 100 and (scores > 0).all() and all(worst)
    flat = [w for t, _ in test for w in abuse.windows_of(t)]
    toxic, ordinary = m._tools()
    assert abuse._bare(flat, toxic, ordinary)[0] == [abuse.undisguised(w) for w in flat]


def test_abuse_from_examples_alone():
    m = abuse.fit_abuse([])
    scores, _ = m.scores(["Shut up, you stupid idiot.", "The committee discussed the budget for next year."])
    assert scores[0] > scores[1]


@pytest.mark.parametrize("texts", [EDGE, []])
def test_edge_texts(texts):
    p = textkind.fit_profiles([])
    stats, languages = textkind.statistics(texts)
    assert len(stats) == len(languages) == len(texts) and np.isfinite(stats).all()
    assert len(p.assign(stats)[0]) == len(texts) if texts else True
    m = subjects.fit_subjects([("ball and game and ball", ["sport"]), ("cup and plate in the kitchen", ["household"])], [("sport", "Games, balls."), ("household", "Cups, plates.")])
    assert len(m.assign(texts)) == len(texts)
    assert len(readlevel.fit_levels([]).levels(texts)) == len(texts)
    a = abuse.fit_abuse([])
    assert len(a.scores(texts)[0]) == len(texts)


def test_models_dont_share_dictionaries():
    for k in range(20):  # models come and go, as in a reused worker
        own = f"zzq{k} brrk wumpus{k} frobnicate"
        m = abuse.fit_abuse([(f"plain sentence number {k} about the budget.", False)] * 3 + [(own, True)] * 3)
        toxic, _ = m._tools()
        # Only a dictionary with these words makes them shorter than they are; the frame alone takes nine bytes.
        assert len(toxic(own.encode())) < len(own)


def test_divergence_is_bounded_and_symmetric():
    rng = np.random.default_rng(0)
    p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
    assert 0 <= textkind.jensen_shannon(p, q) <= 1
    assert textkind.jensen_shannon(p, q) == pytest.approx(textkind.jensen_shannon(q, p))
    assert textkind.jensen_shannon(p, p) == pytest.approx(0)


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p2_composition", "p3_rates", "p3_scores", "p5_statistics"])
def test_queries_run_and_keep_keys(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    if name in ("p3_found", "p4_found", "p5_found", "p3_scores"):
        assert len({r["record_id"] for r in rows}) == len(rows)
    if name == "p2_found":
        assert len({(r["record_id"], r["subject"]) for r in rows}) == len(rows)
    if name == "p3_scores":
        assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/refined_commands_filtered.parquet").count()


def test_queries_without_labels_or_rows(spark, tmp_path):
    for name in ("refined_commands_filtered", "record_labels", "subject_areas", "oldfilteringbig1900cursorcode", "inappropriate_filter_jason", "documents", "climblab_sample"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (df if name == "subject_areas" else df.limit(0)).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, q in queries.queries().items():
        if name == "p8_use":
            continue  # one row of totals
        assert q(spark, str(tmp_path)).count() == 0, name
