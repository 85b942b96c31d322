"""Table schemas, as DDL."""

LAW = (
    "lawBookID BIGINT, lawTitle STRING, lawYear STRING, lawCode STRING, lawDate STRING, date_iso STRING, status_label STRING, lawValid STRING, lawFlag STRING, "
    "full_text STRING, full_text_len BIGINT, category STRING, classification STRING, lawIndex STRING, lawNotes STRING, lawDoc STRING, lawImage STRING, country STRING, "
    "source_url STRING, pdf_url STRING, articles STRING, groupsNewsDate STRING, groupsNewsNum STRING, groupsNewsPage STRING, tacksNewsDate STRING, tacksNewsNum STRING, "
    "tacksNewsPage STRING, tacksPageCount STRING, tacksPartNum STRING, source_type STRING, corpus_id STRING"
)
CARD = "law_book_id BIGINT, title STRING, scope_summary STRING, subject_tags ARRAY<STRING>, colloquial_aliases ARRAY<STRING>, likely_questions ARRAY<STRING>, title_en STRING, model STRING"
LEXICON = "alias STRING, alias_norm STRING, law_book_id BIGINT, title STRING, source STRING"
ARTICLE_INDEX = "law_book_id BIGINT, article_label STRING, role STRING, char_start INT, char_end INT, text STRING, mentions_articles ARRAY<STRING>, in_article STRING, parse_confidence DOUBLE, builder_version STRING"
REGISTRY = "law_book_id BIGINT, title STRING, year STRING, status_label STRING, law_flag STRING, aliases ARRAY<STRING>, aliases_joined STRING, route_text STRING, source_url STRING"
REF = "ARRAY<STRUCT<law_book_id:BIGINT,title:STRING,year:STRING,method:STRING,confidence:STRING>>"
LINK = f"base_law_book_id BIGINT, base_title STRING, base_num STRING, base_year STRING, classification STRING, amended_by {REF}, replaced_by {REF}, builder_version STRING"
CATALOG_ITEM = "lawBookID BIGINT, lawTitle STRING, lawYear STRING, lawCode STRING, lawDate STRING, lawValid STRING, lawFlag STRING, category STRING, classification STRING, lawIndex STRING, lawNotes STRING"
EMPTY_BY_NAME = {"card": CARD, "lexicon": LEXICON, "article_index": ARTICLE_INDEX, "registry": REGISTRY, "link": LINK}
