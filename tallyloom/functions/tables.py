"""Lookup tables whose values must equal those of the material's own tools; all else in the library takes tables as parameters.

Fixed values: everything in this module is given by the file formats and reports that results are compared with.
"""

from __future__ import annotations

# Each list below must hold these words, in this order, for results to agree.

#: an upper-cased reason that holds one of these repeats its instructions
ECHO_MARKERS = ["FORMAT FIX", "YOU MUST", "LINE 1:", "LINE 2:", "OUTPUT EXACTLY", "CRITICAL:", "[FORCED_OPTION]", "OPTION: X"]

#: an exported reason ends before one of these, if it has at least 20 characters before it
ECHO_NEEDLES = [
    "output format (exactly", "first line: option:", "second line: reason:", "format fix.", "do not copy these instructions", "nothing before or after", "line 1: option:", "line 2: reason:",
]

#: a long reason without any of these words is not about the subject
DOMAIN_WORDS = ["insurance", "coverage", "policy", "claim", "liability", "insured", "premium", "underwriting"]

#: bucket, tag, words of which a normalised item holds one; tried in this order, else bucket 1 with the tag "default"
TOPIC_KEYWORDS = [
    (3, "keyword_ca_law", [
        "california", "commissioner", "department of insurance", "insurance code", "cdi", "cease", "desist", "license", "appointment", "fiduciary", "rebate", "unfair", "misrepresentation", "fraud",
        "surplus lines", "nonadmitted", "admitted",
    ]),
    (2, "keyword_contract", [
        "contract", "offer", "acceptance", "consideration", "warranty", "representation", "concealment", "void", "voidable", "rescission", "endorsement", "policy provisions", "cancellation", "nonrenewal",
        "premium return", "loss payable", "mortgage clause", "standard fire policy",
    ]),
    (6, "keyword_valuation_programs", [
        "coinsurance", "replacement cost", "actual cash value", "acv", "valued policy", "fair plan", "ca earthquake authority", "cea", "caarp", "assigned risk", "guaranty association", "valuation",
        "limit offered", "coverage limit",
    ]),
    (5, "keyword_residential", [
        "homeowners", "dwelling", "ho ", "dp ", "residence", "condominium", "fire policy", "property disclosure", "earthquake", "wildfire", "personal property", "coverage a", "coverage b", "coverage c",
        "coverage d", "coverage e", "coverage f",
    ]),
    (7, "keyword_liability_inland", [
        "personal umbrella", "liability", "medical payments", "bodily injury", "property damage", "defense", "suit", "negligence", "defamation", "slander", "libel", "inland marine", "bailee", "floater",
        "accounts receivable", "valuable papers",
    ]),
    (8, "keyword_commercial", [
        "commercial", "cgl", "businessowners", "bop", "workers compensation", "workers' compensation", "employers liability", "equipment breakdown", "builders risk", "crime", "fidelity", "surety", "cargo",
        "ocean marine", "truck", "motor carrier", "umbrella",
    ]),
    (4, "keyword_tort_fundamentals", [
        "tort", "damages", "negligence", "proximate", "strict liability", "defendant", "plaintiff", "loss exposure", "hazard", "peril", "risk management", "avoidance", "retention", "transfer", "sharing",
    ]),
]

#: size, what a lower-cased run name holds one of, what it must not hold; tried in this order, else a dash
MODEL_SIZES = [
    ("1.1B", ["tinyllama"], []), ("9B", ["gemma2_9b"], []), ("2B", ["gemma_2b"], []), ("3.8B", ["phi3"], []), ("7B", ["qwen2.5", "qwen2_5"], []), ("7B", ["mistral"], []),
    ("8B", ["llama3.1", "llama3_1"], []), ("Not disclosed", ["gpt-4o_reasoned"], ["mini"]), ("~8B (est.)", ["gpt-4o-mini"], []), ("~7B (est.)", ["gpt-4_1-mini"], []),
    ("~4B (est.)", ["gpt-4_1-nano"], []), ("Not disclosed", ["gpt-3_5", "gpt-3.5"], []),
]

#: spoken answers as transcribed, tried in this order; None takes the letter that the pattern's group holds
SPOKEN_ANSWERS = [
    ("B", r"\banswer\s+beat\b"), ("B", r"\banswer\s+be\b"), ("B", r"\banswer\s+the\s+insurable"), ("C", r"\banswer\s+see\b"), ("A", r"\band survey\s+to\b"),
    (None, r"\bando\s+([a-d])\b"), (None, r"\band so\s+([a-d])"), (None, r"\banswer\s+([a-d])(?:\s|subreg|explanation|$|,|\.)"),
]

#: what transcripts say, and what is meant
PHRASE_FIXES = [("flashc cards", "flash cards"), ("multiplechoice", "multiple-choice"), ("coins insurance", "coinsurance"), ("topics insurance regulation", "topics, including insurance regulation")]

#: beginnings of a question's first line, blanks taken out
QUESTION_STARTS = [
    "which", "what", "when", "who", "how", "where", "why", "allofthefollowing", "aspecial", "itisunlawful", "itis", "the", "california", "except", "under", "ifa", "during", "whois", "howlong", "whena",
    "apolicy", "aninsured", "incalifornia",
]

#: whole lines, or their beginnings, that a study page prints around its items
PAGE_JUNK = [
    r"\d+/\d+", r"\d+\s+of\s+\d+", r"T\s*e\s*r\s*m", r"Don\s*'\s*t\s+know\s*\?", "Give this one a go", r"No problem\.", r"No worries\.", r"Not quite\.", "You'?ve got this!", "You'?re doing great!", "Excellent!",
    "Brilliant work!", "Retest using", "Turn these into", "Correct", "Incorrect", "Your time:", "Your answer", "Study Online", "Click to Save", r"\d{1,2}/\d{1,2}/\d{2},",
]

#: what a page says about an answer, squashed
FEEDBACK = [
    "givethisoneagolater", "givethisoneago", "noworries", "notquite", "noproblem", "brilliant", "excellent", "yourestilllearning", "youvegothis", "youredoinggreat",
]
