"""Schemas of the document tree, the store and the line relations."""

from __future__ import annotations

IMAGE = "struct<id:string,filename:string,width:int,height:int,caption:string>"
QUESTION = (
    "struct<id:string,number:int,text:string,options:array<string>,sub_items:array<string>,correct_answer:string,"
    f"ai_solution:string,show_solution:boolean,raw_html:string,images:array<{IMAGE}>,option_images:array<array<{IMAGE}>>>"
)
SECTION = f"struct<id:string,type:string,label:string,intro:string,is_theory:boolean,questions:array<{QUESTION}>>"
SCOPE = "struct<mode:string,grade:int,chapter_id:string,cumulative:boolean,allow:string,deny:string>"
DOCUMENT = (
    "struct<id:bigint,title:string,subject:string,grade:int,chapter:string,semester:string,doc_type:string,"
    f"ai_scope:{SCOPE},sections:array<{SECTION}>>"
)
LIBRARY = "id long, title string, subject string, grade int, chapter string, semester string, doc_type string, content_json string, created_at timestamp, updated_at timestamp"
HISTORY = "id long, document_id long, question_id string, question_text string, solution_text string, model_used string, tokens_used int, created_at timestamp"
SETTINGS = "key string, value string"

# The names that stored documents use for section and document types.
MULTIPLE_CHOICE, TRUE_FALSE, SHORT_ANSWER, ESSAY, THEORY, OTHER = "trac_nghiem_lua_chon", "dung_sai", "tra_loi_ngan", "tu_luan", "ly_thuyet", "khac"
EXAM, WORKSHEET, OTHER_DOCUMENT = "de_thi", "phieu_bai_tap", "khac"
