"""Names and schemas that the operators share."""

from __future__ import annotations

CHANGE_KINDS = ("Added", "Modified", "Renamed")
BLOCK_KINDS = ("Paragraph", "Heading", "TableCell", "ListItem", "BlockQuote")

#: First characters of every generated document; a parameter wherever it is used.
HEADER_PREFIX = "<!-- translated-document:"
HEADER_SUFFIX = "-->"

CHUNKS = "path string, ordinal int, chunk_id string, source_text string, content_hash string, block_kind string, start int, stop int, placeholders map<int,string>, links map<int,struct<url:string,title:string,is_image:boolean>>, emphasis map<int,struct<delim:string,count:int>>"
MEMORY = "path string, target_lang string, content_hash string, translated_text string"
GLOSSARY = "version int, case_sensitive boolean, dont_translate array<string>, custom_mappings map<string,map<string,string>>"
REPLY = "translations array<struct<chunkId:string,translatedText:string>>"
EVENTS = "category string, path string, target_lang string, message string"

# Event categories in the order of the reports, with their titles.
SECTIONS = {
    "stale": "Stale translations detected",
    "glossary": "Glossary warnings",
    "healed": "Self-healed (marker repaired after retry)",
    "untranslated": "Left untranslated (markers kept dropping after repair attempts)",
    "skipped": "Skipped (unexpected reconstruction failure)",
}
