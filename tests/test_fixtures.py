"""Hand-written cases with known outcomes, one operator at a time."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from colloquy.functions import labels, text as tx, tokens
from colloquy.operators import align, chunking, factcheck, glossary as gl, minutes, prompts, rendering
from colloquy.operators.cleaning import clean_text
from colloquy.operators.glossary import Term
from colloquy.schemas import BLOCKS, QA_PAIRS, SECTIONS, SEGMENTS, TRANSCRIPTS, TURNS
from colloquy.sources import exports, files, model_output as mo

PINYIN = {ch: s for s, g in {"shi": "示事世市", "li": "例立力利", "dian": "电垫店点", "zi": "子字资紫", "liu": "流留六刘",
                             "pian": "片篇偏便", "fan": "返反", "tou": "投"}.items() for ch in g}


def value(spark, make, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).head()[0]


# ------------------------------------------------------------------- cleaning
@pytest.mark.parametrize("text,want", [
    ("赵一:\n先过一遍日程\n赵一:\n再看预算表", "赵一:\n先过一遍日程再看预算表"),
    ("K:\nx\nK:\ny\nL:\nz\nK:\nw", "K:\nxy\n\nL:\nz\n\nK:\nw"),
    ("no labels", "no labels"), ("  ", "  "),
    ("lead\nK:\nx", "lead\n\n\nK:\nx"),
])
def test_merge_speaker_text(spark, text, want):
    assert value(spark, tx.merge_speaker_text, text) == want


@pytest.mark.parametrize("text,want", [
    ("嗯今天开会", "今天开会"), ("嗯啊那个这个", ""), ("嗯  然后  就是", ""), ("  ", ""), ("就是说好", "说好")])
def test_fillers(spark, text, want):
    assert value(spark, tx.remove_fillers, text) == want


def test_custom_fillers(spark):
    assert value(spark, lambda c: tx.remove_fillers(c, ["custom", "xyz"]), "custom test xyz done") == "test done"


@pytest.mark.parametrize("text,want", [
    ("零", None), ("十", 10), ("十一", 11), ("二十", 20), ("abc", None), ("", None), ("二零二四", 4), ("万一", 10001),
    ("一万亿", 100010000), ("十二亿三千四百五十六万七千八百九十", 1234567890), ("一万三千", 13000), ("五百万", 5000000)])
def test_chinese_numeral(spark, text, want):
    assert value(spark, tx.chinese_numeral, text) == want


@pytest.mark.parametrize("text,want", [
    ("两千五百", "2500[原:两千五百]"), ("收入三百万元", "收入3000000[原:三百万]元"), ("一个", "一个"), ("零零", "零零")])
def test_normalize_numbers(spark, text, want):
    assert value(spark, tx.normalize_numbers, text) == want


@pytest.mark.parametrize("text,want", [
    ('{"text": "早上好。"}\n{"text": "开始吧。"}', "早上好。\n开始吧。"), ('{"text": "a"}\nplain', '{"text": "a"}\nplain'),
    ('{"text": 1}', '{"text": 1}'), ('{"text": "a"} x', '{"text": "a"} x'),
    ("1\n00:00:01,000 --> 00:00:02,000\n你好\n\n2\n00:00:02,000 --> 00:00:03,000\n再见", "你好\n再见"),
    ("WEBVTT\n\n00:01 --> 00:02\nhi\nNOTE x", "hi")])
def test_normalize_export(spark, text, want):
    assert value(spark, exports.normalize_export_text, text) == want


def test_clean(spark):
    got = value(spark, clean_text, "赵一:\n嗯今天三百元\n赵一:\n然后收入不错\n钱二:\n啊是的")
    assert got == "赵一:\n今天300[原:三百]元收入不错\n\n钱二:\n是的"


@pytest.mark.parametrize("text,want", [("说明。" * 30, "narration"), ("为什么？好" * 30, "qa"), ("", "narration")])
def test_transcript_type(spark, text, want):
    assert value(spark, tx.transcript_type, text) == want


# ------------------------------------------------------------------ alignment
def turns(spark, rows):
    return spark.createDataFrame([(1, i, float(s), float(e), p) for i, (s, e, p) in enumerate(rows)], TURNS)


def segments(spark, rows):
    return spark.createDataFrame([(1, i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows)], SEGMENTS)


BASE = [(0.0, 56.6, 0), (57.1, 119.7, 1)]


def test_assign_speaker(spark):
    s = segments(spark, [(10, 12, "a"), (70, 72, "b"), (56, 58, "c"), (55, 58, "d"), (200, 201, "e")])
    got = align.assign_speaker(s, turns(spark, BASE)).orderBy("seg_ord").select("speaker").collect()
    assert [r[0] for r in got] == [0, 1, 1, 0, None]


def test_merge_short_turns(spark):
    t = turns(spark, [(0, 56.6, 0), (30.3, 30.9, 1), (57.1, 119.7, 2)])
    assert [r.speaker for r in align.merge_short_turns(t).orderBy("turn_ord").collect()] == [0, 0, 2]
    only = turns(spark, [(0, 0.5, 3), (1, 1.4, 4)])
    assert [r.speaker for r in align.merge_short_turns(only).orderBy("turn_ord").collect()] == [3, 4]


@pytest.mark.parametrize("rows,gap,want", [
    ([(0.03, 56.61, 0), (30.32, 30.95, 0)], 0.5, [(0.03, 56.61, 0)]),
    ([(57.12, 89.33, 1), (89.70, 104.71, 1)], 0.5, [(57.12, 104.71, 1)]),
    ([(0, 10, 0), (12, 20, 0)], 0.5, [(0, 10, 0), (12, 20, 0)]), ([(0, 10, 0), (12, 20, 0)], 3.0, [(0, 20, 0)]),
    ([(0, 10, 0), (5, 12, 1)], 0.5, [(0, 10, 0), (5, 12, 1)])])
def test_coalesce_turns(spark, rows, gap, want):
    got = align.coalesce_turns(turns(spark, rows), gap).orderBy("start").select("start", "end", "speaker").collect()
    assert [tuple(r) for r in got] == want


def test_blocks_and_labels(spark):
    t = turns(spark, BASE)
    s = segments(spark, [(0, 10, "甲"), (10, 20, "乙"), (60, 70, "丙")])
    got = align.group_by_speaker(s, t).orderBy("block_ord").select("speaker", "text", "end").collect()
    assert [tuple(r) for r in got] == [(0, "甲乙", 20.0), (1, "丙", 70.0)]
    s = segments(spark, [(0, 20, "一"), (200, 210, "二"), (210, 220, "三")])
    assert [r.text for r in align.labeled_transcript(s, t).collect()] == ["说话人0:\n一二三"]
    s = segments(spark, [(300, 301, "丢"), (0, 20, "甲说"), (60, 90, "乙说")])
    got = align.labeled_transcript(s, t, {0: "访谈方", 1: "项目方"}).orderBy("block_ord").collect()
    assert [r.text for r in got] == ["访谈方:\n甲说", "项目方:\n乙说"]


def test_dominant_share(spark):
    assert align.dominant_share(turns(spark, [(0, 63, 0), (63, 100, 1)])).head().share == pytest.approx(0.63)
    assert align.dominant_share(turns(spark, [(1, 1, 0)])).head().share == 0.0


def test_stitch_segments(spark):
    windows = align.chunk_windows(spark.createDataFrame([(1, 30.0)], "recording_id bigint, total double"), 10.0, 5.0)
    rows = [(s, e, t) for s, e, t in [(0.0, 4.0, "a"), (6.0, 9.0, "b"), (12.0, 14.0, "重叠区")]]
    local = windows.crossJoin(spark.createDataFrame(rows, "start double, end double, text string"))
    got = align.stitch_segments(local, 10.0).orderBy("start").collect()
    assert [r.start for r in got] == [0.0, 6.0, 10.0, 16.0, 20.0, 26.0]


def test_asr_payloads(spark):
    ok = '{"segments":[{"start":0,"end":1,"text":" "},{"end":2,"text":"x"},{"start":1.0,"end":2.0,"text":"有效"}]}'
    df = spark.createDataFrame([(1, 600.0, ok), (2, 0.0, "plain"), (3, 0.0, '{"text": "x"}')],
                               "recording_id bigint, offset double, payload string")
    good, bad = exports.parse_asr_segments(df)
    assert [(r.start, r.end, r.text) for r in good.collect()] == [(601.0, 602.0, "有效")]
    assert sorted(r.recording_id for r in bad.collect()) == [2, 3]


# ------------------------------------------------------------------- glossary
def one(spark, text):
    return spark.createDataFrame([(1, text)], TRANSCRIPTS)


@pytest.mark.parametrize("terms,text,want,hits", [
    ([Term("星河仪表", "", ("星河仪标",))], "把星河仪标的报价发出去", "把星河仪表的报价发出去", 1),
    ([Term("ARPU", "", ("ARPV",))], "ARPV 环比持平，ARPVX 另算", "ARPU 环比持平，ARPVX 另算", 1),
    ([Term("OpenMP", "", ("openmp",))], "改用 Openmp 并行", "改用 OpenMP 并行", 1),
    ([Term("流片", "", ("流片",))], "流片", "流片", 0),
    ([Term("星河仪表", "", ("星河仪标",)), Term("星河集团", "", ("星河",))], "星河仪标一侧", "星河仪表一侧", 1),
    ([Term("HBM", "", ("HBM2E", "HBM内存", "h+b"))], "HBM2E与HBM内存，H+B", "HBM与HBM，HBM", 3)])
def test_apply_exact(spark, terms, text, want, hits):
    assert gl.apply_exact(one(spark, text), terms).head().text == want
    found = gl.exact_hits(one(spark, text), terms).collect()
    assert len(found) == hits
    for h in found:
        assert text[h.start:h.end] == h.matched
        assert h.context == f"{text[max(0, h.start - 12):h.start]}【{h.matched}】{text[h.end:h.end + 12]}"


@pytest.mark.parametrize("word,text,want", [
    ("力点资源", "走访力店资源的仓库", ["力店资源"]), ("利市", "他们立世多年", []), ("返点", "点返了两回", []),
    ("返点", "本月反点结算", ["反点"]), ("返点", "本\x02月反点结算", ["反点"]), ("力点资源", "力点，资的货", []), ("力点资源", "力点资源", [])])
def test_scan_phonetic(spark, word, text, want):
    got = gl.scan_phonetic(one(spark, text), [Term(word)], PINYIN).collect()
    assert [r.matched for r in got] == want
    assert all(text[r.start:r.end] == r.matched for r in got)


@pytest.mark.parametrize("text,want", [
    ("力店资源；力店资源", [0, 5]), ("力点资源" + "力店资源" * 9, []), ("力店资源" * 12, [4 * i for i in range(12)]),
    ("力点资源" * 7 + "力店资源", [28])])
def test_scan_variants(spark, text, want):
    terms = [Term("力点资源", "", (), ("力店资源",))]
    assert [r.start for r in gl.scan_variants(one(spark, text), terms).orderBy("start").collect()] == want


def test_scan_all(spark):
    text = "昨天去力店资源盘货"
    with_variant = gl.scan_all(one(spark, text), [Term("力点资源", "", (), ("力店资源",))], PINYIN).collect()
    assert [r.kind for r in with_variant] == ["variant"]
    assert [r.kind for r in gl.scan_all(one(spark, text), [Term("力点资源")], PINYIN).collect()] == ["phonetic"]


def test_expand(spark):
    table = spark.createDataFrame([(c, s, True, ord(c)) for c, s in PINYIN.items()], "ch string, syllable string, common boolean, cp int")

    def expand(corrections=(), **kw):
        g = gl.glossary_table(spark, [Term("利点资片", "", corrections)])
        return [r.variant for r in gl.expand_glossary(g, table, **kw).orderBy("variant_ord").collect()]

    every = expand()
    assert {"力点资片", "利店资片", "利点字片", "利点资篇"} <= set(every) and "利点资片" not in every
    few = expand(max_variants=4)
    assert [sum(a != b for a, b in zip(v, "利点资片")) for v in few] == [1] * 4
    assert {next(i for i in range(4) if v[i] != "利点资片"[i]) for v in few} == {0, 1, 2, 3}
    assert "力店资片" in expand(max_positions=2, max_variants=200)
    assert "利店资片" not in expand(corrections=("利店资片",))


def brute_fuzzy(text, term):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    low = text.lower()
    return any(distance(low[i:i + len(w)], w) <= 2 for w in term.corrections for i in range(len(low) - len(w) + 1))


def test_fuzzy_corrections(spark):
    import random

    rng = random.Random(7)
    terms = [Term("OpenMP", "", ("openmp",)), Term("abcabc", "", ("abcab", "cabbac"))]
    texts = ["opnmp is used", "zzzz"] + ["".join(rng.choice("abcopenm") for _ in range(14)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), TRANSCRIPTS)
    got = {(r.meeting_id, r.term) for r in gl.fuzzy_corrections(df, terms).collect()}
    assert got == {(i, t.term) for i, x in enumerate(texts) for t in terms if brute_fuzzy(x, t)}
    assert gl.fuzzy_corrections(one(spark, "zz"), [Term("T", "", ("ab",))]).count() == 1


def test_terms_report(spark):
    hits = gl.exact_hits(one(spark, "星河仪标、星河仪标"), [Term("星河仪表", "", ("星河仪标",))])
    doc = rendering.assemble(rendering.render_term_report(hits)).head().text
    assert doc.startswith("## 术语纠错\n\n**已自动纠正 2 处**") and "- `星河仪标` → **星河仪表**（2 处）" in doc


# ---------------------------------------------------------- chunks and merging
def chunks(spark, text, size, overlap=200):
    return [r.chunk for r in chunking.chunk_text(one(spark, text), "text", size, overlap).orderBy("chunk_ord").collect()]


def test_chunk_text(spark):
    assert chunks(spark, "短文本", 2000) == ["短文本"] and chunks(spark, "", 2000) == [""]
    cut = chunks(spark, "开场白。" + "x" * 480 + "。再往后。" + "y" * 520, 300)
    assert len(cut) >= 2 and all(len(c) <= 330 for c in cut[:-1])
    cut = chunks(spark, "m" * 470 + "seam of both" + "n" * 530, 400, 100)
    assert cut[0][-100:] in cut[1]
    text = "".join(f"句子{i}，很长的话。\n" for i in range(400))
    rows = chunking.chunk_text(one(spark, text), "text", 1000, 100).orderBy("chunk_ord").collect()
    whole = ""
    for r in rows:
        assert text[r.chunk_start:r.chunk_start + len(r.chunk)] == r.chunk and r.chunk_start <= len(whole)
        whole = whole[:r.chunk_start] + r.chunk
    assert whole == text


def test_trim_rewrite_overlap(spark):
    df = spark.createDataFrame([(1, 0, "part1 commonPart"), (1, 1, "commonPart part3 and the rest")],
                               "meeting_id bigint, chunk_ord int, text string")
    assert chunking.trim_rewrite_overlap(df).orderBy("chunk_ord").collect()[1].text == " part3 and the rest"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, 0, k, t, x) for i, (k, t, x) in enumerate(rows)], BLOCKS)


@pytest.mark.parametrize("rows,titles", [
    ([("narration", "公司概况", "x"), ("qa", "融资", "y"), ("mixed", "产能", "z")], ["公司概况", "产能"]),
    ([("narration", "价格", "A1"), ("narration", "价格", "A2")], ["价格"]),
    ([("narration", "价格", "a"), ("narration", "工艺", "b"), ("narration", "价格", "c")], ["价格", "工艺", "价格"]),
    ([("narration", "1. 价格", "a"), ("narration", "价格", "b")], ["价格"]), ([("narration", "", "a")], ["未命名"])])
def test_merge_blocks(spark, rows, titles):
    got = minutes.merge_blocks(blocks(spark, rows)).orderBy("sec_ord").collect()
    assert [r.title for r in got] == titles


def test_topic_blocks(spark):
    df = spark.createDataFrame([(1, 0, "not json"), (1, 1, '```json\n[{"topic": "A", "text": "t"}]\n```'), (1, 2, "[]")],
                               "meeting_id bigint, chunk_ord int, response string")
    got = mo.parse_topic_blocks(df).orderBy("chunk_ord").collect()
    assert [(r.type, r.topic, r.text) for r in got] == [
        ("narration", "", "not json"), ("narration", "A", "t"), ("narration", "", "[]")]


def pairs(spark, rows):
    return spark.createDataFrame([(1, i, q, a, "", "", "") for i, (q, a) in enumerate(rows)], QA_PAIRS)


def test_drop_redundant_qa(spark):
    said = "公司主要从事滤波器封装业务，去年营收增长百分之三十，客户集中在华东地区。"
    sections = spark.createDataFrame([(1, 0, "t", said, [])], SECTIONS)
    df = pairs(spark, [("介绍", said), ("完全无关的另一个提问内容是什么呢", "这里讨论的是海外渠道建设与招聘计划")])
    assert [r.qa_ord for r in minutes.drop_redundant_qa(df, sections).collect()] == [1]
    assert minutes.drop_redundant_qa(pairs(spark, [("公司", "主要从事")]), sections).count() == 1


def test_json_ladder(spark):
    rows = ['{"a": [1, 2]', '{"a": 1}', '```json\n{"a": 1}\n```', "none", 'x {"a": 1} y']
    got = mo.parse_json_ladder(spark.createDataFrame(list(enumerate(rows)), "i int, result string")).orderBy("i").collect()
    assert [(r.rung, r.json) for r in got] == [
        ("fragment", '{"a": [1, 2]}'), ("direct", '{"a": 1}'), ("fenced", '{"a": 1}'), ("none", None), ("fragment", '{"a": 1}')]


def test_estimate_calls(spark):
    df = one(spark, "一" * 17400)
    assert [prompts.estimate_calls(df, f).head().calls for f in ("qa", "speech", "both")] == [3, 5, 8]


# ------------------------------------------------------------------ fact check
def test_citations(spark):
    t = one(spark, "line one\nline two\nline three")
    s = spark.createDataFrame([(1, 0, "t", "c", ["L1", "l3", "invalid_ref", "L99", "×1", "§1"])], SECTIONS)
    got = factcheck.check_citations(s, t).orderBy("cit_ord").collect()
    assert [(r.line_index, r.content, r.valid) for r in got] == [
        (1, "line one", True), (3, "line three", True), (-1, None, False), (99, None, False), (0, "", True),
        (1, "line one\nline two\nline three", True)]


def cover(spark, text, contents, **kw):
    s = spark.createDataFrame([(1, i, "t", c, []) for i, c in enumerate(contents)], SECTIONS)
    return factcheck.coverage_report(one(spark, text), s, pairs(spark, []), **kw).head()


def test_coverage(spark):
    text = "门店本季流水2.4亿，退货率7%。" * 6
    assert (cover(spark, text, [text]).ratio, cover(spark, text, [text]).uncovered_chunks) == (1.0, 0)
    assert cover(spark, text, []).ratio == 0.0
    assert (cover(spark, "", ["x"]).total_chunks, cover(spark, "", ["x"]).ratio) == (0, 1.0)
    assert (cover(spark, "甲" * 500, ["乙" * 200]).ratio, cover(spark, "甲" * 500, ["乙" * 200]).uncovered_chunks) == (0.0, 1)
    assert cover(spark, "甲" * 700 + "。" + "乙" * 8000, ["甲" * 700]).ratio < 0.60


def test_number_tokens(spark):
    got = value(spark, tokens.number_tokens, "流水2.4亿，退货7%，计划27年开店，会员增到9000万")
    assert {"2.4亿", "7%", "27", "2027", "9000万"} <= set(got)
    assert set(value(spark, tokens.number_tokens, "1.2-1.5亿")) == {"1.2亿", "1.5亿", "1.2", "1.5"}


def test_confidence(spark):
    s = spark.createDataFrame([(1, i, "t", "c", ["L1"]) for i in range(3)], SECTIONS)
    assert factcheck.fact_check_report(None, s, pairs(spark, [("q", "a")])).head().confidence_score == 0.75


# --------------------------------------------------------------- review drafts
BODY = "# 校验稿\n\n## 主题要点\n\n前言\n### 新一代架构\n内容一\n\n### 高端产品进度\n内容二\n\n## 其他章节\n### 不算\nx\n"


def test_review_sections(spark):
    got = value(spark, lambda c: F.to_json(mo.review_sections(c)), BODY)
    assert got == ('[{"title":"","content":"前言"},{"title":"新一代架构","content":"内容一"},'
                   '{"title":"高端产品进度","content":"内容二"}]')


@pytest.mark.parametrize("text,want", [
    ("**Q**：问一\n**A**：答一\n\n**Q2**：问二\n**A2**：答二", [("问一", "答一"), ("问二", "答二")]),
    ("Q: only\nQ: second\nfoo\nA: x", [("only\nQ: second\nfoo", "x")]), ("Q：没有回答", [("没有回答", "")]),
    ("【问】甲\n【答】乙\n\n【问】丙【答】丁", [("甲", "乙"), ("丙", "丁")]),
    ("请问公司产能如何\n大约十万片\n\n## 标题\n\n嗯嗯：x", [("请问公司产能如何", "大约十万片")])])
def test_review_pairs(spark, text, want):
    got = value(spark, mo.review_pairs, text)
    assert [(p.question, p.answer) for p in got] == want


@pytest.mark.parametrize("t,keep", [("14:05-14:08", True), ("14:05:11-14:08:59", True), ("4:05", True), ("当前", False),
                                    ("2023-2028", False), ("上午", False), ("第1段", False)])
def test_timerange(spark, t, keep):
    assert (value(spark, labels.valid_timerange, t) is not None) == keep


@pytest.mark.parametrize("raw,role", [("提问方", "interviewer"), ("投资方", "interviewer"), ("项目方", "interviewee"),
                                      ("创始人", "interviewee"), ("双方", ""), ("赵一", ""), ("被访谈方", "interviewer")])
def test_roles(spark, raw, role):
    assert value(spark, labels.normalize_asker_role, raw) == role


def test_labels(spark):
    for args, want in [(("张总", "interviewer"), "张总"), (("", "interviewee"), "项目方"), (("", "unknown"), "（未指明）")]:
        assert value(spark, labels.asker_label, *args) == want
    assert value(spark, labels.topics_similar, "先进封装", "先进封装技术") is True
    assert value(spark, labels.topics_similar, "价格", "工艺") is False


def test_secrets(spark):
    assert value(spark, tx.redact_secrets, "sk-" + "a" * 24 + " api_key: 'abcdefghij0123456789'") == "sk-*** api_key: '***'"
    assert value(spark, tx.mask_key, "gsk_abcdef") == "gsk_***def"


# ----------------------------------------------------------- prompts and files
def test_hotwords(spark):
    g = gl.glossary_table(spark, [Term("流片"), Term("流片"), Term(" "), Term("封装")])
    assert prompts.hotword_prompt(g).head().prompt.endswith("流片、封装。")
    many = gl.glossary_table(spark, [Term(f"术语{i}") for i in range(200)])
    assert len(prompts.hotword_prompt(many).head().prompt) <= 180


def test_generate_keeps_failures(spark):
    def fn(p):
        if "坏" in p.rsplit("：\n", 1)[-1]:
            raise RuntimeError("no")
        return "{}"

    df = spark.createDataFrame([(1, "好"), (2, "坏")], TRANSCRIPTS)
    answers = prompts.generate(prompts.build_prompts(df, "qa", date(2026, 1, 31)), fn)
    assert [r.meeting_id for r in prompts.failed_meetings(answers).collect()] == [2]


def test_import_results_asks_again(spark):
    t = one(spark, "一期投资3.5亿，二期投资12亿，产能80万片，良率95%，客户27家，员工1200人。" * 30)
    r = spark.createDataFrame([(1, '{"qa_pairs": [{"question": "天气", "answer": "晴"}]}')], "meeting_id bigint, result string")
    _, _, coverage, follow = prompts.import_results(t, r, date(2026, 1, 31))
    assert not coverage.head().ok and "片段1" in follow.head().prompt


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("你好\n再见", encoding="utf-8")
    (tmp_path / "b.pdf").write_text("x", encoding="utf-8")
    assert [r.text for r in files.read_transcripts(spark, str(tmp_path)).collect()] == ["你好\n再见"]
    terms = [Term("HBM", "高带宽", ("HBN",), ("HBMM",)), Term("EUV")]
    dumped = files.dump_glossary(terms, "半导体")
    assert dumped["terms"][1] == {"term": "EUV"} and files.load_glossary(dumped) == terms
    for bad in ({"terms": "x"}, {"terms": [{"context": "y"}]}, []):
        with pytest.raises(ValueError):
            files.load_glossary(bad)
    assert files.load_background({"company": "c", "known_consensus": None})["known_consensus"] == []
    assert files.load_background(None)["industry"] == "未知"
    assert files.load_template({"name": "t", "sections": [{"title": "总结"}]}).sections[0].title == "总结"
    assert files.glossary_from_output('```yaml\n{"terms": [{"term": "A"}]}\n```') == [Term("A")]
    path = files.write_table(one(spark, "x").withColumn("day", F.lit("d")), str(tmp_path), "clean", ["day"])
    assert spark.read.parquet(path).count() == 1
    doc = spark.createDataFrame([(1, "a\nb")], "meeting_id bigint, text string")
    out = files.write_documents(doc, str(tmp_path), "drafts")
    assert [tuple(r) for r in spark.read.json(out).collect()] == [(1, "a\nb")]


def test_resolve_review(spark):
    front = '{"qa_pairs": [{"question": "旧问", "answer": "旧答"}], "sections": [{"title": "旧题", "content": "旧文"}]}'
    drafts = [(1, f"---\n{front}\n---\n\n# 校验稿\n"), (2, f"---\n{front}\n---\n\n**Q**：新问\n**A**：新答\n")]
    sections, asked = mo.resolve_review(spark.createDataFrame(drafts, TRANSCRIPTS))
    assert sorted((r.meeting_id, r.question, r.answer) for r in asked.collect()) == [(1, "旧问", "旧答"), (2, "新问", "新答")]
    assert sorted((r.meeting_id, r.title, r.content) for r in sections.collect()) == [(1, "旧题", "旧文"), (2, "旧题", "旧文")]


def test_variants_overlap_only_each_other(spark):
    terms = [Term("abab", "", (), ("aa", "aaa")), Term("x.y", "", (), ("x\\Ey",))]
    hits = gl.scan_variants(one(spark, "aaaa x\\Ey aa"), terms).orderBy("matched", "start").collect()
    assert [(h.matched, h.start, h.end) for h in hits] == [("aa", 0, 2), ("aa", 2, 4), ("aa", 10, 12), ("aaa", 0, 3), ("x\\Ey", 5, 9)]


def test_json_prefix_is_found_in_one_pass():
    cases = {'x {"a": 1, "b": {"c": 2': '{"a": 1}', '{"a": {"b": 1}': "{}", '{"a": {"b": 1} ': '{"a": {"b": 1} }', "no": None,
             '{"a": "}"} tail': '{"a": "}"}', '{"a": [1, 2], "b': '{"a": [1, 2]}', "{": "{}"}
    assert {t: mo._closed_object(t) for t in cases} == cases
    assert mo._closed_object('{"a": 1, "b": "' + "x" * 1_000_000) == '{"a": 1}'


def test_files_of_one_name_and_undecodable_ones(spark, tmp_path):
    for folder, name, data in (("a", "talk.txt", "eins".encode()), ("b", "talk.txt", "\ufeffzwei\n".encode()), ("b/c d%20", "x.y.MD", "ü".encode()),
                               ("a", "latin.txt", "ü".encode("latin-1")), ("a", "empty.md", b""), ("a", "picture.png", b"\x89")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        assert {(r.meeting_id, r.text) for r in files.read_transcripts(spark, root).collect()} == {
            ("a/talk", "eins"), ("b/talk", "zwei\n"), ("b/c d%20/x.y", "ü")}
        assert [(r.meeting_id, r.bytes, r.problem) for r in files.rejected_files(spark, root).collect()] == [("a/latin", 1, "not UTF-8")]
