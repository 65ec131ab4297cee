"""Schemas of the tables the library reads and writes, as DDL."""

TRANSCRIPTS = "meeting_id bigint, text string"
TURNS_TEXT = "meeting_id bigint, turn_ord int, speaker string, text string"
SEGMENTS = "recording_id bigint, seg_ord int, start double, end double, text string"
TURNS = "recording_id bigint, turn_ord int, start double, end double, speaker int"
ASR_PAYLOADS = "recording_id bigint, offset double, payload string"
GLOSSARY = ("glossary_id string, term_ord int, term string, context string, "
            "corrections array<string>, auto_variants array<string>")
PINYIN = "ch string, syllable string, common boolean, cp int"
BLOCKS = "meeting_id bigint, chunk_ord int, block_ord int, type string, topic string, text string"
SECTIONS = "meeting_id bigint, sec_ord int, title string, content string, citations array<string>"
QA_PAIRS = ("meeting_id bigint, qa_ord int, question string, answer string, asker string, "
            "asker_role string, timerange string")
TEMPLATES = "name string, description string, sec_ord int, title string, prompt string"
BACKGROUNDS = ("meeting_id bigint, company string, industry string, participants string, "
               "known_consensus array<string>, meeting_purpose string")
