"""Queries on glossaries: correction, detection, expansion, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glossary as gl
from ..operators.glossary import Term
from . import inputs
from .inputs import with_

# Inline dimensions: a glossary for the invented Latin prose and one for the derived Han text.
LATIN = (
    Term("TION", "a suffix", ("tion", "tions")),
    Term("That", "a pronoun", ("that", "thth", "hat")),
    Term("Schein", "a noun", ("schein", "einein", "Schein")),
    Term("The", "an article", ("the", "tion")),
)
HAN = (
    Term("例电", "", ("例垫", "例垫一", "力垫"), ("立电", "例店", "力电")),
    Term("示例", "", ("示立",), ("事例", "示力", "市例")),
    Term("一三", "", (), ("一一", "千千", "一百")),
    Term("电示事", "", (), ()),
    Term("例垫万", "", (), ()),
)
FUZZY = (Term("Einheitlich", "", ("einheitlich", "verkeitenschen")), Term("Thereof", "", ("therethand",)),
         Term("示例电子", "", ("示例电子示例",)))


# Syllables of the invented prose; a hexadecimal digit is one of them.
SYLLABLES = ("the", "an", "er", "on", "in", "en", "ou", "re", "ei", "sch", "un", "th", "le", "ion", "que", "nd")
FORMS_PER_PART = 8
PART_FORMS = (Term("Widget", "", ("wigdet", "widgett")), Term("Gizmo", "", ("gismo", "gitsmo")), Term("Economy", "", ("ekonomy",)),
              Term("Ring", "", ("rink",)), Term("Standard", "", ("stanndart",)), Term("at", "", ("a",)))


def apply_exact(spark, sf):
    return gl.apply_exact(inputs.transcripts(spark, sf), LATIN)


def apply_exact_han(spark, sf):
    return gl.apply_exact(inputs.cjk_transcripts(spark, sf), HAN)


def exact_hits(spark, sf):
    return gl.exact_hits(inputs.transcripts(spark, sf), LATIN).withColumnsRenamed({"start": "hit_start", "end": "hit_end"})


def scan_variants(spark, sf):
    return gl.scan_variants(inputs.cjk_transcripts(spark, sf), HAN).withColumnsRenamed(
        {"start": "hit_start", "end": "hit_end"})


def _sounds(spark):
    return gl.pinyin_map(inputs.pinyin(spark))


def scan_phonetic(spark, sf):
    return gl.scan_phonetic(inputs.cjk_transcripts(spark, sf), HAN, _sounds(spark)).withColumnsRenamed(
        {"start": "hit_start", "end": "hit_end"})


def scan_all(spark, sf):
    return gl.scan_all(inputs.cjk_transcripts(spark, sf), HAN, _sounds(spark)).withColumnsRenamed(
        {"start": "hit_start", "end": "hit_end"})


def _part_glossary(spark, sf):
    """Part names in Han letters as terms; one of their homophones is a known error."""
    term = F.translate(F.lower("p_name"), inputs.CJK_FROM, inputs.CJK_TO)
    return inputs.table(spark, sf, "part").select(
        F.lit("parts").alias("glossary_id"), F.col("p_partkey").cast("int").alias("term_ord"), term.alias("term"),
        F.col("p_type").alias("context"),
        F.array(F.regexp_replace(term, "电(?=.*)", "垫"), F.replace(term, F.lit("立"), F.lit("利"))).alias("corrections"))


def expand_glossary(spark, sf):
    return gl.expand_glossary(_part_glossary(spark, sf), inputs.pinyin(spark))


def expand_glossary_two_positions(spark, sf):
    return gl.expand_glossary(_part_glossary(spark, sf), inputs.pinyin(spark), max_positions=2)


def variant_stats(spark, sf):
    return gl.variant_stats(expand_glossary(spark, sf))


def term_frequency(spark, sf):
    return gl.term_frequency(inputs.transcripts(spark, sf), LATIN)


def filter_terms(spark, sf):
    return gl.filter_terms(inputs.transcripts(spark, sf), LATIN)


def hit_summary(spark, sf):
    return gl.hit_summary(gl.exact_hits(inputs.transcripts(spark, sf), LATIN))


def corpus_hit_summary(spark, sf):
    return gl.corpus_hit_summary(gl.exact_hits(inputs.transcripts(spark, sf), LATIN))


def fuzzy_corrections(spark, sf):
    return gl.fuzzy_corrections(inputs.transcripts(spark, sf), FUZZY)


def fuzzy_part_corrections(spark, sf):
    parts = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("meeting_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    # The rows of so narrow a table are a few splits, and each is compared with every form.
    parts = parts.repartition("meeting_id", "text")
    return gl.fuzzy_corrections(parts, PART_FORMS, min_len=3)


def _spelled(n):
    """Four syllables for a number."""
    digits = F.split(F.lpad(F.hex(n), 4, "0"), "")
    return F.array_join(F.transform(digits, lambda d: F.get(F.array(*map(F.lit, SYLLABLES)), F.conv(d, 16, 10).cast("int"))), "")


def _han(n, size):
    """A number in the Han letters of the derived texts, which are thirteen."""
    return F.translate(F.lpad(F.conv(n.cast("string"), 10, 13), size, "0"), "0123456789ABC", inputs.CJK_TO)


def _large_glossary(spark, sf):
    """Every part is a term of several Latin forms and several Han ones: eight forms of each kind for each part."""
    key = F.col("p_partkey")
    more = lambda first, form: F.transform(F.sequence(F.lit(first), F.lit(FORMS_PER_PART - 1)),
                                           lambda j: form(key * FORMS_PER_PART + j))
    # However few splits the file has, every task gets its share of the forms.
    parts = inputs.table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(
        F.lit("parts").alias("glossary_id"), key.cast("int").alias("term_ord"), _han(key * FORMS_PER_PART, 5).alias("term"),
        F.lit("").alias("context"), more(0, _spelled).alias("corrections"), more(1, lambda n: _han(n, 5)).alias("auto_variants"))


def large_exact_hits(spark, sf):
    return gl.exact_hits(inputs.transcripts(spark, sf), _large_glossary(spark, sf)).withColumnsRenamed({"start": "hit_start", "end": "hit_end"})


def large_apply_exact(spark, sf):
    return gl.apply_exact(inputs.transcripts(spark, sf), _large_glossary(spark, sf))


def large_scan_variants(spark, sf):
    return gl.scan_variants(inputs.cjk_transcripts(spark, sf), _large_glossary(spark, sf)).withColumnsRenamed({"start": "hit_start", "end": "hit_end"})


def large_scan_phonetic(spark, sf):
    terms = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("term_ord"), _han(F.col("p_partkey") * 2411 % 13 ** 6, 6).alias("term"))
    # However few splits the file has, every task gets its share of the texts.
    texts = inputs.cjk_transcripts(spark, sf).repartition("meeting_id", "text")
    return gl.scan_phonetic(texts, terms, _sounds(spark)).withColumnsRenamed({"start": "hit_start", "end": "hit_end"})


def large_term_frequency(spark, sf):
    glossary = _large_glossary(spark, sf).withColumn("corrections", F.col("auto_variants"))
    return gl.term_frequency(inputs.cjk_transcripts(spark, sf), glossary)


QUERIES = {f.__name__: f for f in (
    apply_exact, apply_exact_han, exact_hits, scan_variants, scan_phonetic, scan_all, expand_glossary,
    expand_glossary_two_positions, variant_stats, term_frequency, filter_terms, hit_summary,
    corpus_hit_summary, fuzzy_corrections, fuzzy_part_corrections, large_exact_hits, large_apply_exact, large_scan_variants,
    large_scan_phonetic, large_term_frequency)}

# ------------------------------------------------------------------------ oracle


def _pairs(mapping) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(mapping.items())) + ")"


# What the glossaries above say, written out.
_MAP = {"tion": "TION", "tions": "TION", "that": "That", "thth": "That", "hat": "That", "schein": "Schein", "einein": "Schein", "the": "The"}
# An ASCII form with free neighbours is a whole run of letters and digits.
_RUNS = f"""
    runs AS (SELECT meeting_id, i, rs[i] AS run FROM (
        SELECT meeting_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM (
            SELECT meeting_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS rs FROM transcripts))),
    dict AS (SELECT * FROM {_pairs(_MAP)} d(n, wrong, correct)),
    mapped AS (SELECT meeting_id, i, run, correct,
                   (sum(length(run)) OVER (PARTITION BY meeting_id ORDER BY i))::INTEGER AS stop
               FROM runs LEFT JOIN dict ON wrong = lower(run))"""
_SNIP = ("replace(text[greatest({s} - 11, 1):{s}] || '【' || text[{s} + 1:{e}] || '】' || text[{e} + 1:{e} + 12], chr(10), ' ')")
_HITS = _RUNS + f""",
    hits AS (SELECT m.meeting_id, correct AS term, run AS matched, stop - length(run) AS hit_start, stop AS hit_end,
                 'exact' AS kind, {_SNIP.format(s='(stop - length(run))', e='stop')} AS context
             FROM mapped m JOIN transcripts t ON t.meeting_id = m.meeting_id WHERE correct IS NOT NULL)"""
_HAN_MAP = {"例垫": "例电", "例垫一": "例电", "力垫": "例电", "示立": "示例"}
_VARIANT_MAP = {"立电": "例电", "例店": "例电", "力电": "例电", "事例": "示例", "示力": "示例", "市例": "示例", "一一": "一三", "千千": "一三", "一百": "一三"}
_HAN_RE = "|".join(sorted(_HAN_MAP, key=len, reverse=True))
_HAN_CASE = "CASE found[i] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HAN_MAP.items()) + " ELSE '' END"
_VARIANTS = f"""
    dict AS (SELECT * FROM {_pairs(_VARIANT_MAP)} d(n, variant, correct)),
    cut AS (SELECT meeting_id, text, n, variant, correct, string_split(text, variant) AS ps,
                len(string_split(text, correct)) - 1 AS rights FROM cjk, dict WHERE contains(text, variant)),
    kept AS (SELECT * FROM cut WHERE NOT (rights > 0 AND len(ps) - 1 > greatest(5, rights))),
    spots AS (SELECT meeting_id, n, variant, correct, text, i,
                  (sum(length(ps[i]) + length(variant)) OVER (PARTITION BY meeting_id, n ORDER BY i))::INTEGER AS stop
              FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM kept)),
    vhits AS (SELECT *, stop - length(variant) AS start, row_number() OVER (
                  PARTITION BY meeting_id ORDER BY n, stop) AS rn FROM spots),
    variants AS (SELECT meeting_id, correct AS term, variant AS matched, start AS hit_start, stop AS hit_end,
                     'variant' AS kind, {_SNIP.format(s='start', e='stop')} AS context FROM vhits)"""
_STAND = {ch: group[0] for group in inputs.PINYIN_GROUPS.values() for ch in group}
_SOUND = f"translate({{}}, '{''.join(_STAND)}', '{''.join(_STAND.values())}')"
_WORDS = "(VALUES " + ", ".join(f"({i}, '{t.term}')" for i, t in enumerate(HAN)) + ")"
_PHONETIC = f"""
    cs AS (SELECT meeting_id, i - 1 AS pos, c[i] || coalesce(c[i + 1], '') AS w2,
                  CASE WHEN i + 2 <= len(c) THEN c[i] || c[i + 1] || c[i + 2] END AS w3
           FROM (SELECT meeting_id, c, unnest(range(1, len(c))) AS i FROM (
                 SELECT meeting_id, string_split(text, '') AS c FROM cjk))),
    words AS (SELECT *, {_SOUND.format('word')} AS sound FROM {_WORDS} w(n, word)),
    wins AS (SELECT w, sw, count(*) FROM (SELECT w2 AS w, {_SOUND.format('w2')} AS sw FROM cs
             UNION ALL SELECT w3, {_SOUND.format('w3')} FROM cs) WHERE w IS NOT NULL GROUP BY ALL),
    matches AS (SELECT n, word, w, CASE WHEN w[1] = word[1] THEN 0 WHEN w[2] = word[2] THEN 1 ELSE 2 END AS offs
        FROM wins JOIN words ON length(w) = length(word) AND w <> word
        WHERE (w[1] = word[1] OR w[2] = word[2] OR (length(w) = 3 AND w[3] = word[3]))
          AND regexp_full_match(w, '[\\x{{4e00}}-\\x{{9fff}}]+')
          AND len(list_intersect(list_distinct(string_split(w, '')), list_distinct(string_split(word, '')))) >= 1
          AND (sw[1] <> sound[1])::INT + (sw[2] <> sound[2])::INT + (length(w) = 3 AND sw[3] <> sound[3])::INT
              <= CASE WHEN length(w) <= 2 THEN 0 ELSE 1 END),
    found AS (SELECT meeting_id, n, word, w, offs, pos::INTEGER AS start FROM cs
              JOIN matches ON w = w2 UNION ALL
              SELECT meeting_id, n, word, w, offs, pos::INTEGER FROM cs JOIN matches ON w = w3),
    phits AS (SELECT *, start + length(w) AS stop, row_number() OVER (
                  PARTITION BY meeting_id ORDER BY n, offs, start) AS rn FROM found),
    phonetic AS (SELECT p.meeting_id, word AS term, w AS matched, start AS hit_start, stop AS hit_end,
                     'phonetic' AS kind, {_SNIP.format(s='start', e='stop')} AS context
                 FROM phits p JOIN cjk c ON c.meeting_id = p.meeting_id)"""
_PART_TERM = f"translate(lower(p_name), '{inputs.CJK_FROM}', '{inputs.CJK_TO}')"
_EXPAND = with_("pinyin", also=f"""
    terms AS (SELECT p_partkey::INTEGER AS term_ord, {_PART_TERM} AS term FROM part),
    spots AS (SELECT term_ord, term, i - 1 AS pos, term[i] AS ch
              FROM (SELECT *, unnest(range(1, length(term) + 1)) AS i FROM terms WHERE length(term) >= 2)),
    options AS (SELECT term_ord, term, pos, o.ch AS other, row_number() OVER (
                    PARTITION BY term_ord, pos ORDER BY o.cp) AS rank
                FROM spots s JOIN pinyin p ON p.ch = s.ch JOIN pinyin o ON o.syllable = p.syllable AND o.ch <> s.ch),
    turned AS (SELECT *, row_number() OVER (PARTITION BY term_ord ORDER BY rank, pos) AS variant_ord FROM options),
    expanded AS (SELECT 'parts' AS glossary_id, term_ord, term, variant_ord::INTEGER AS variant_ord,
                     term[:pos] || other || term[pos + 2:] AS variant FROM turned),
    open AS (SELECT * FROM expanded WHERE variant <> replace(term, '电', '垫') AND variant <> replace(term, '立', '利'))""")


def _count_sql(t: Term) -> str:
    forms = [f.lower() for f in (t.term, *t.corrections)]
    return " + ".join(f"(length(low) - length(replace(low, '{f}', ''))) // {len(f)}" for f in forms)


_FREQ = with_("transcripts", also="l AS (SELECT meeting_id, lower(text) AS low FROM transcripts), freq AS ("
              + " UNION ALL ".join(f"SELECT meeting_id, {i} AS term_ord, '{t.term}' AS term, ({_count_sql(t)})::BIGINT "
                                   "AS occurrences FROM l" for i, t in enumerate(LATIN)) + ")")

ORACLE = {
    "apply_exact": with_("transcripts", also=_RUNS) + """
        SELECT meeting_id, string_agg(coalesce(correct, run), '' ORDER BY i) AS text FROM mapped GROUP BY meeting_id""",
    "apply_exact_han": with_("cjk", also=f"""
        p AS (SELECT meeting_id, string_split_regex(text, '{_HAN_RE}') AS rest,
                     regexp_extract_all(text, '{_HAN_RE}') AS found FROM cjk),
        q AS (SELECT meeting_id, i, rest[i] || {_HAN_CASE} AS part
              FROM (SELECT *, unnest(range(1, len(rest) + 1)) AS i FROM p))""") + """
        SELECT meeting_id, string_agg(part, '' ORDER BY i) AS text FROM q GROUP BY meeting_id""",
    "exact_hits": with_("transcripts", also=_HITS) + "SELECT * FROM hits",
    "scan_variants": with_("cjk", also=_VARIANTS) + "SELECT * FROM variants",
    "scan_phonetic": with_("cjk", also=_PHONETIC) + "SELECT * FROM phonetic",
    "scan_all": with_("cjk", also=_VARIANTS + "," + _PHONETIC + """,
        both_ AS (SELECT * FROM variants UNION ALL SELECT p.* FROM phonetic p WHERE NOT EXISTS (
            SELECT 1 FROM variants v WHERE v.meeting_id = p.meeting_id AND v.hit_start = p.hit_start
            AND v.matched = p.matched))""") + "SELECT * FROM both_",
    "expand_glossary": _EXPAND + "SELECT * FROM open",
    "expand_glossary_two_positions": _EXPAND.rstrip() + """,
        single AS (SELECT term_ord, term, variant_ord, pos, term[:pos] || other || term[pos + 2:] AS variant
                   FROM turned),
        again AS (SELECT o.term_ord, o.term, s.variant[:o.pos] || o.other || s.variant[o.pos + 2:] AS variant,
                      min(row(s.variant_ord, o.pos, o.rank)) AS seen
                  FROM options o JOIN single s ON s.term_ord = o.term_ord AND s.pos <> o.pos GROUP BY ALL),
        counts AS (SELECT term_ord, count(*) AS n FROM single GROUP BY term_ord),
        later AS (SELECT a.term_ord, term, n + row_number() OVER (PARTITION BY a.term_ord ORDER BY seen) AS variant_ord, variant
                  FROM again a JOIN counts c ON c.term_ord = a.term_ord),
        both_ AS (SELECT term_ord, term, variant_ord, variant FROM single
                  UNION ALL SELECT * FROM later)
        SELECT 'parts' AS glossary_id, term_ord, term, variant_ord, variant FROM both_
        WHERE variant <> replace(term, '电', '垫') AND variant <> replace(term, '立', '利')""",
    "variant_stats": _EXPAND + """SELECT glossary_id, term_ord, term, count(*) AS variants FROM open
        GROUP BY ALL""",
    "term_frequency": _FREQ + "SELECT * FROM freq WHERE occurrences > 0",
    "filter_terms": _FREQ + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id
        ORDER BY occurrences DESC, term_ord)::INTEGER AS rank FROM freq WHERE occurrences > 0)""",
    "hit_summary": with_("transcripts", also=_HITS + """,
        g AS (SELECT meeting_id, kind, matched, term, count(*) AS hits, arg_min(context, hit_start) AS context,
                  min(hit_start) AS seen FROM hits GROUP BY meeting_id, kind, matched, term),
        r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, kind ORDER BY seen)::INTEGER AS group_ord,
                  sum(hits) OVER (PARTITION BY meeting_id, kind)::BIGINT AS kind_hits,
                  0::BIGINT AS more_groups FROM g)""") + """
        SELECT * EXCLUDE (seen) FROM r""",
    "corpus_hit_summary": with_("transcripts", also=_HITS) + """SELECT kind, term, count(*) AS hits,
        count(DISTINCT meeting_id) AS meetings FROM hits GROUP BY ROLLUP (kind, term)""",
}
# Every window of a form's length within two edits; no form has Han letters.
ORACLE["fuzzy_part_corrections"] = """
    WITH forms AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{t.term}', '{w}')" for i, t in enumerate(PART_FORMS) for w in t.corrections if len(w) >= 3) + """) f(term_ord, term, form)),
    texts AS (SELECT p_partkey AS meeting_id, lower(p_name || ' ' || p_type) AS low FROM part),
    windows AS (SELECT meeting_id, term_ord, term, form, unnest(list_transform(range(1, length(low) - length(form) + 2),
        lambda i: low[i:i + length(form) - 1])) AS w FROM texts, forms)
    SELECT DISTINCT meeting_id, term_ord, term FROM windows WHERE levenshtein(w, form) <= 2"""

# SQL that finds the variants, sounds and edits of these on whole texts is too slow; tests compare them with plain programs.
# The large glossary: a term has the numbers from p_partkey * 8 on, in syllables and in Han letters.
_SPELLED = ("array_to_string(list_transform(string_split(lpad(to_hex(x), 4, '0'), ''), lambda d: ["
            + ", ".join(f"'{x}'" for x in SYLLABLES) + "][strpos('0123456789ABCDEF', d)]), '')")


def _han_sql(n: str, size: int) -> str:
    return f"translate(lpad(upper(to_base({n}, 13)), {size}, '0'), '0123456789ABC', '{inputs.CJK_TO}')"


# Slices count graphemes, which is slow on whole texts; these count characters.
_PLACE = ("replace(substr(text, greatest({s} - 11, 1), {s} - greatest({s} - 11, 1) + 1) || '【' || substr(text, {s} + 1, {e} - {s}) || '】' "
          "|| substr(text, {e} + 1, 12), chr(10), ' ')")
_LARGE = f"""
    numbers AS (SELECT p_partkey::INTEGER AS term_ord, j::INTEGER AS j, (p_partkey * {FORMS_PER_PART} + j)::BIGINT AS x,
                    {_han_sql(f'p_partkey * {FORMS_PER_PART}', 5)} AS term FROM part, range({FORMS_PER_PART}) r(j)),
    spelled AS (SELECT form, arg_min(term, x) AS correct FROM (SELECT *, {_SPELLED} AS form FROM numbers) GROUP BY form),
    runs AS (SELECT meeting_id, i, rs[i] AS run FROM (
        SELECT meeting_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM (
            SELECT meeting_id, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS rs FROM transcripts))),
    mapped AS (SELECT meeting_id, i, run, correct,
                   (sum(length(run)) OVER (PARTITION BY meeting_id ORDER BY i))::INTEGER AS stop
               FROM runs LEFT JOIN spelled ON form = lower(run))"""
_FIVE = f"""
    han AS MATERIALIZED (SELECT meeting_id, text FROM cjk),
    numbers AS (SELECT p_partkey::INTEGER AS term_ord, j::INTEGER AS j, {_han_sql(f'p_partkey * {FORMS_PER_PART}', 5)} AS term,
                    {_han_sql(f'p_partkey * {FORMS_PER_PART} + j', 5)} AS form FROM part, range({FORMS_PER_PART}) r(j)),
    cs AS MATERIALIZED (SELECT DISTINCT meeting_id, c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4] AS form FROM (
        SELECT meeting_id, c, unnest(range(1, len(c) - 3)) AS i FROM (SELECT meeting_id, string_split(text, '') AS c FROM han))),
    met AS MATERIALIZED (SELECT meeting_id, term_ord, j, term, form, list_transform(string_split(text, form), lambda p: length(p) + 5) AS ls
            FROM cs JOIN numbers USING (form) JOIN han USING (meeting_id))"""
ORACLE |= {
    "large_exact_hits": with_("transcripts", also=_LARGE) + f"""
        SELECT m.meeting_id, correct AS term, run AS matched, stop - length(run) AS hit_start, stop AS hit_end,
            'exact' AS kind, {_PLACE.format(s='(stop - length(run))', e='stop')} AS context
        FROM mapped m JOIN transcripts t ON t.meeting_id = m.meeting_id WHERE correct IS NOT NULL""",
    "large_apply_exact": with_("transcripts", also=_LARGE) + """
        SELECT meeting_id, string_agg(coalesce(correct, run), '' ORDER BY i) AS text FROM mapped GROUP BY meeting_id""",
    "large_term_frequency": with_("cjk", also=_FIVE) + """
        SELECT meeting_id, term_ord, term, sum((length(text) - length(replace(text, form, ''))) // 5)::BIGINT AS occurrences
        FROM cs JOIN numbers USING (form) JOIN han USING (meeting_id) GROUP BY ALL""",
}
