"""A neutral demonstration vocabulary: queries, intents, domains and boosts as rows.

Every operator that uses rules takes them as a parameter of these shapes.
"""

from __future__ import annotations

#: (query_id, text)
QUERIES = [
    (1, "apache license version"),
    (2, "contact email of the section"),
    (3, "the edition of this"),
    (4, "de la ment"),
    (5, "und die keit"),
    (6, "license 2020 or 2021"),
    (7, "ti on"),
    (8, "ation thing that"),
]

#: (intent, any of these substrings, required intent, pass); pass 2 may require intents of pass 1
INTENTS = [
    ("licensing", ["license", "copyright", "apache"], None, 1),
    ("contact", ["email", "contact", "phone", "@"], None, 1),
    ("greeting", ["hello", "bonjour", "hallo"], None, 1),
    ("howto", ["how ", "why ", "what "], None, 1),
    ("toxicity", ["idiot", "moron"], None, 1),
    ("licensing_version", ["version", "2.0"], "licensing", 2),
    ("contact_mail", ["@", "email"], "contact", 2),
]

#: (rank, domain, intents of which one is needed): the first that fits wins
DOMAINS = [
    (1, "legal", ["licensing_version", "licensing"]),
    (2, "people", ["contact", "contact_mail"]),
    (3, "support", ["howto"]),
]

#: (rank, keyword, domain), tried in order where no intent routes
KEYWORDS = [(1, "the ", "general"), (2, "der ", "general_de"), (3, " le ", "general_fr"), (4, " el ", "general_es")]

#: Greeting-like messages that are never routed
TRIVIAL = ["hi", "hello", "ok", "thanks"]

#: What a follow-up message holds
FOLLOWUP = ["that", "this", "it ", "more", "and "]

#: Field weights of the term score
FIELD_WEIGHTS = {"path": 5.0, "title": 4.0, "source": 4.0, "record_type": 6.0, "text": 1.0}

#: SQL expressions that give documents the catalogue fields the boosts look at; valid in Spark and in ANSI engines alike
SOURCE_NUMBER = "coalesce(try_cast(substr(source, 4) as int), 0)"
RECORD_TYPE = "case lang when 'en' then 'guide' when 'de' then 'notice' when 'fr' then 'profile' else '' end"
PRIORITY = f"case when {SOURCE_NUMBER} < 5 then 'P0' when {SOURCE_NUMBER} < 10 then 'P1' else 'P2' end"
YEAR = f"2020 + {SOURCE_NUMBER} % 7"
STATUS = (
    f"case {SOURCE_NUMBER} % 6 when 0 then concat('current_', cast({YEAR} as string)) when 1 then 'current_or_undated' when 2 then 'historical_result' "
    "when 3 then 'historical_archive' when 4 then 'versioned_page_verify_year' else "
    f"case {SOURCE_NUMBER} % 12 when 5 then 'planned_subject_to_change' else 'recruitment_closed_early' end end"
)
#: domain -> predicate over (record_type, source, lang, path)
DOMAIN_PREDICATES = {
    "legal": "record_type = 'guide' and source in ('src1', 'src2', 'src3')",
    "people": "record_type in ('profile', 'notice')",
    "support": "path like 'src1%' or contains(path, '/en/')",
    "general": "not (record_type = '')",
}

# fixed values: points by year and by temporal status, in the order in which they are tried
#: (condition, points) of the year
YEAR_POINTS = [("size(asked) = 0", 0), ("effective_year is null", -20), ("array_contains(asked, effective_year)", 170), ("true", -220)]
#: (status, condition, points, whether the year's points are added)
STATUS_POINTS = [
    ("current_20[0-9]{2}", "size(asked) = 0", "35", True),
    ("current_20[0-9]{2}", "true", "10", True),
    ("current_or_undated", "true", "15", True),
    ("planned_subject_to_change", "wants_plan", "130", True),
    ("planned_subject_to_change", "true", "-180", True),
    ("recruitment_closed.*", "wants_plan", "120", True),
    ("recruitment_closed.*", "true", "-180", True),
    ("historical_result", "size(asked) > 0", "0", True),
    ("historical_result", "wants_result", "10 + greatest(0, effective_year - 2024)", False),
    ("historical_result", "true", "-70", False),
    ("historical.*", "size(asked) > 0", "0", True),
    ("historical.*", "true", "-80", False),
    ("versioned_page_verify_year", "true", "-50", True),
]
#: What a question may ask for: name -> (years, plans, results)
ASKED = {"no_year": ([], False, False), "years": ([2021, 2022], False, False), "plans": ([], True, False), "results": ([], False, True)}
