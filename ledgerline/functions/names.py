"""Names of medical facilities: one normal form for matching, and the guard against names of type words alone."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import nfkc

#: Legal-entity terms (fixed values).
LEGAL_ENTITIES = [
    "社会医療法人社団", "社会医療法人財団", "特定医療法人社団", "特定医療法人財団", "医療法人社団", "医療法人財団", "医療法人", "社会医療法人",
    "特定医療法人", "独立行政法人", "国立研究開発法人", "地方独立行政法人", "国立大学法人", "公立大学法人", "学校法人", "公益社団法人",
    "一般社団法人", "公益財団法人", "一般財団法人", "社会福祉法人", "恩賜財団", "厚生農業協同組合連合会", "農業協同組合連合会", "厚生連",
    "国民健康保険団体連合会", "共済組合連合会",
]
#: Facility types and clinical departments (fixed values).
TYPE_WORDS = [
    "病院", "医院", "診療所", "クリニック", "医療センター", "センター", "歯科医院", "歯科診療所", "歯科クリニック", "歯科", "薬局",
    "内科", "外科", "眼科", "耳鼻科", "耳鼻咽喉科", "皮膚科", "皮膚泌尿器科", "産婦人科", "産科", "婦人科", "小児科", "精神科", "神経科", "神経内科",
    "心療内科", "整形外科", "形成外科", "美容外科", "脳神経外科", "呼吸器科", "呼吸器内科", "循環器科", "循環器内科", "消化器科", "消化器内科",
    "泌尿器科", "放射線科", "麻酔科", "リハビリテーション科", "リハビリ科", "アレルギー科", "腫瘍内科", "乳腺外科", "肛門科", "胃腸科",
]
#: Symbols that names drop, the long-vowel mark among them (fixed value).
SYMBOLS = "・･｡｢｣「」『』【】()（）[]｛｝{}<>〈〉《》〔〕、。，．,.!！?？:：;；~～-ー－―_/／\\｜|"


def without_symbols(text: Column) -> Column:
    return F.translate(text, SYMBOLS, "")


def _longest_first(terms: list[str]) -> list[str]:
    return sorted(set(terms), key=lambda t: (-len(t), t))


def _without(text: Column, terms: list[str]) -> Column:
    for term in _longest_first(terms):
        text = F.replace(text, F.lit(term), F.lit(""))
    return text


def type_words_only(name: Column) -> Column:
    """Whether nothing is left of a normal name without facility types and departments (an empty one included)."""
    plain = [unicodedata.normalize("NFKC", w).lower().translate({ord(c): None for c in SYMBOLS}) for w in TYPE_WORDS]
    return _without(name, plain) == ""


def normal_name(name: Column) -> Column:
    """NFKC, lower case, no white space, no symbols, no legal-entity terms; these stay where else only type words would be left."""
    plain = without_symbols(F.regexp_replace(F.lower(nfkc(name)), r"(?U)\s+", ""))
    short = _without(plain, LEGAL_ENTITIES)
    return F.when(type_words_only(short), plain).otherwise(short)
