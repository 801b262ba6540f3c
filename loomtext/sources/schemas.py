"""Explicit schemas of all records."""

ARTICLE = "title string, source string, date string, author array<string>, section string, highlight string, full_text string"
CLASSIFIED = ARTICLE + ", predicted_topic string"
GOLD = "id string, iptc_filtered array<string>, text string"
GOLD_TREE = "doc struct<token_string:string, annotations:struct<iptc_codes:struct<certain:array<array<array<string>>>>>>"
TAXONOMY = "mapping map<string, array<string>>"
WINDOW = "struct<label:string, ai_assistance_score:double, confidence:string>"
DETECTOR = (
    "article_index bigint, title string, date string, source string, predicted_topic string, text_length int, "
    f"fraction_ai double, fraction_ai_assisted double, fraction_human double, num_ai_segments int, windows array<{WINDOW}>, error string"
)
TOKEN = "struct<id:int, text:string, lemma:string, upos:string, feats:string, deprel:string, head:int>"
PARSED = (
    "title string, source string, date string, author string, section string, predicted_topic string, text_scope string, "
    f"char_count int, word_count_title int, parsed_sentences array<array<{TOKEN}>>"
)
LEXICON = "text string, lemma string, upos string, xpos string, frequency bigint"
SCORED_WORDS = "key string, lemma string, upos string, G2 double, LPR double, c_H bigint, c_M bigint"
CATEGORY_LIST = "lemma string, category string"
