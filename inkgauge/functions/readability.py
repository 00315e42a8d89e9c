"""Readability formulas over the counts of ``text_counts``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import safe_div


def flesch_kincaid_grade(words: Column, sents: Column, syllables: Column) -> Column:
    return 0.39 * safe_div(words, sents) + 11.8 * safe_div(syllables, words) - 15.59


def gunning_fog(words: Column, sents: Column, complex_words: Column) -> Column:
    return 0.4 * (safe_div(words, sents) + 100 * safe_div(complex_words, words))


def coleman_liau_index(words: Column, sents: Column, letters: Column) -> Column:
    return 0.0588 * (100 * safe_div(letters, words)) - 0.296 * (100 * safe_div(sents, words)) - 15.8


def smog_index(sents: Column, polysyllables: Column) -> Column:
    return 1.043 * F.sqrt(safe_div(polysyllables * 30, sents)) + 3.1291


def ari(words: Column, sents: Column, characters: Column) -> Column:
    return 4.71 * safe_div(characters, words) + 0.5 * safe_div(words, sents) - 21.43


def dale_chall(words: Column, sents: Column, difficult: Column) -> Column:
    pct = 100 * safe_div(difficult, words)
    score = 0.1579 * pct + 0.0496 * safe_div(words, sents)
    return F.when(pct > 5, score + 3.6365).otherwise(score)
