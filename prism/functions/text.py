"""Keyword classifiers of chat messages (T1, T2) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the message classifier (must equal the reference's).
VISUALIZATION_WORDS = ["graphique", "plot", "visualise", "chart"]
EXPLORATION_WORDS = ["résumé", "aperçu", "explore", "montre", "structure"]
ANALYSIS_WORDS = ["corrél", "analyse", "test", "régression"]

# Fixed values: (type, intent, suggested_approach, complexity) per class.
CLASS_INFO = {
    "visualization": ("Création de visualisation", "Graphique", "medium"),
    "data_exploration": ("Exploration des données", "Statistiques descriptives", "low"),
    "data_analysis": ("Analyse statistique", "Analyse avancée", "high"),
    "general_question": ("Question générale", "Réponse informative", "low"),
}


def _any_word(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(low, F.lit(w))
    return cond


def classify_type(text: Column) -> Column:
    """T1 type: first matching rule wins (visualization, exploration, analysis, general)."""
    return (F.when(_any_word(text, VISUALIZATION_WORDS), F.lit("visualization"))
            .when(_any_word(text, EXPLORATION_WORDS), F.lit("data_exploration"))
            .when(_any_word(text, ANALYSIS_WORDS), F.lit("data_analysis"))
            .otherwise(F.lit("general_question")))


def classify_message(text: Column) -> Column:
    """struct(type, intent, suggested_approach, complexity)."""
    t = classify_type(text)

    def pick(k: int) -> Column:
        e = None
        for name, info in CLASS_INFO.items():
            e = F.when(t == name, F.lit(info[k])) if e is None else e.when(t == name, F.lit(info[k]))
        return e

    return F.struct(t.alias("type"), pick(0).alias("intent"), pick(1).alias("suggested_approach"),
                    pick(2).alias("complexity"))


def classify_message_degraded(text: Column) -> Column:
    """The degraded-mode order -- exploration first, then visualization, else help."""
    return (F.when(_any_word(text, EXPLORATION_WORDS), F.lit("data_exploration"))
            .when(_any_word(text, VISUALIZATION_WORDS), F.lit("visualization"))
            .otherwise(F.lit("help")))
