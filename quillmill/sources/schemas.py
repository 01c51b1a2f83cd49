"""Explicit schemas of the inputs; nothing is ever inferred."""

from __future__ import annotations

MESSAGE = "STRUCT<role: STRING, content: STRING>"
INSTRUCTIONS = "input STRING, target STRING"
CHAT = f"source STRING, model_name STRING, messages ARRAY<{MESSAGE}>"
PREFERENCES = f"prompt ARRAY<{MESSAGE}>, chosen ARRAY<{MESSAGE}>, rejected ARRAY<{MESSAGE}>"
PROGRAMMING_QA = "text_markdown STRING, answer_count INT, answers STRUCT<text_markdown: ARRAY<STRING>, score: ARRAY<INT>>"
QA_CHOICE = "question STRING, answers ARRAY<STRUCT<answer: STRING, score: INT>>"
QA_SETS = "train STRUCT<question_and_answer: ARRAY<STRUCT<question: STRING, answer: STRING>>, question_and_many_answers: ARRAY<STRUCT<question: STRING, answers: ARRAY<STRUCT<answer: STRING, score: INT>>>>>, validation STRUCT<question_and_answer: ARRAY<STRUCT<question: STRING, answer: STRING>>, question_and_many_answers: ARRAY<STRUCT<question: STRING, answers: ARRAY<STRUCT<answer: STRING, score: INT>>>>>"
TRIPLES = "INSTRUCTION STRING, RESPONSE STRING, SOURCE STRING"
RAG = "question STRING, context STRING, response STRING"
STRUCTURED = "train MAP<STRING, ARRAY<ARRAY<STRING>>>, validation MAP<STRING, ARRAY<ARRAY<STRING>>>, text_corpus ARRAY<STRING>"
ARTICLES = "title STRING, document ARRAY<STRUCT<section_title: STRING, section_body: ARRAY<STRING>>>"
