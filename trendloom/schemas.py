"""Declared table schemas, label vocabularies and literal dimension tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BOOL, INT, DOUBLE = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


YEARS = list(range(2010, 2024))
FIRST_YEAR, LAST_YEAR = YEARS[0], YEARS[-1]

# ---------------------------------------------------------------------------
# The label vocabulary of the response schema.
# ---------------------------------------------------------------------------
TECHNIQUES = [
    "transformer_llm", "computer_vision_cnn", "classical_ml", "neural_network_general",
    "generative_model", "reinforcement_learning", "speech_audio", "knowledge_graph",
    "optimization", "ai_hardware", "not_applicable",
]
DOMAINS = [
    "nlp_text", "computer_vision_imaging", "healthcare_medical", "autonomous_systems",
    "finance_business", "robotics", "security_privacy", "networking_infrastructure",
    "consumer_electronics", "industrial_manufacturing", "gaming_entertainment",
    "productivity_enterprise", "speech_audio", "scientific_research",
    "ai_methods_infrastructure", "education", "automotive", "social_media", "agriculture",
    "energy_management", "other",
]
MODALITIES = ["image_video", "text_language", "audio_speech", "sensor_tabular", "multimodal", "other"]
ORIENTATIONS = ["fundamental", "applied", "both"]
TASKS = [
    "classification_detection", "generation", "optimization_planning", "prediction", "control",
    "decision_support", "other",
]
CONTRIBUTIONS = [
    "algorithmic", "architectural", "system_integration", "application_implementation",
    "data_method",
]
PARADIGMS = [
    "supervised", "unsupervised_selfsupervised", "reinforcement_learning", "few_shot_zeroshot",
    "not_specified",
]
CONFIDENCES = ["high", "medium", "low"]

VOCABULARY = {
    "ai_technique": TECHNIQUES,
    "application_domain": DOMAINS,
    "data_modality": MODALITIES,
    "innovation_orientation": ORIENTATIONS,
    "core_ai_task": TASKS,
    "contribution_type": CONTRIBUTIONS,
    "training_paradigm": PARADIGMS,
    "confidence": CONFIDENCES,
}

# Technique groupings used by the trend tables (unmapped -> 'other').
TECH_GROUPS = {
    "neural_network_general": "neural_network_general",
    "computer_vision_cnn": "cnn_convolutional",
    "transformer_llm": "transformer_attention",
    "classical_ml": "classical_ml",
    "generative_model": "generative_model",
    "speech_audio": "other",
    "reinforcement_learning": "reinforcement_learning",
    "optimization": "optimization",
}
TECH_GROUPS_WITH_SPEECH = {**TECH_GROUPS, "speech_audio": "speech_audio_tech"}
STACK_ORDER = [
    "neural_network_general", "cnn_convolutional", "transformer_attention", "classical_ml",
    "generative_model", "reinforcement_learning", "optimization", "other",
]
# Grouping of the two-office comparison (unmapped -> NULL).
TECH_COMPARISON = {
    "neural_network_general": "Neural net\n(general)",
    "computer_vision_cnn": "CNN /\nconvolutional",
    "transformer_llm": "Transformer /\nattention",
    "classical_ml": "Classical ML",
    "generative_model": "Generative\nmodel",
    "speech_audio": "Speech\n& audio",
}
# Rows and columns of the technique x domain table.
HEATMAP_TECHS = [
    "neural_network_general", "cnn_convolutional", "transformer_attention", "classical_ml",
    "generative_model", "speech_audio_tech", "reinforcement_learning", "optimization",
]
HEATMAP_DOMAINS = [
    "computer_vision_imaging", "nlp_text", "healthcare_medical", "autonomous_systems",
    "ai_methods_infrastructure", "consumer_electronics", "industrial_manufacturing",
    "speech_audio",
]
# Captions (unmapped codes are shown as they are).
DOMAIN_CAPTIONS = {
    "computer_vision_imaging": "Imaging",
    "nlp_text": "NLP / text",
    "healthcare_medical": "Healthcare",
    "autonomous_systems": "Autonomous systems",
    "ai_methods_infrastructure": "AI methods &\ninfrastructure",
    "consumer_electronics": "Consumer electronics",
    "industrial_manufacturing": "Industrial / mfg.",
    "speech_audio": "Speech & audio",
    "finance_business": "Finance & business",
    "robotics": "Robotics",
    "security_privacy": "Security & privacy",
    "networking_infrastructure": "Networking",
    "gaming_entertainment": "Gaming & entertainment",
    "productivity_enterprise": "Productivity / enterprise",
    "scientific_research": "Scientific research",
    "other": "Other",
}
CONTRIBUTION_CAPTIONS = {
    "algorithmic": "Algorithmic",
    "application_implementation": "Application /\nimplementation",
    "system_integration": "System\nintegration",
    "architectural": "Architectural",
    "data_method": "Data method",
}
TECH_GROUP_CAPTIONS = {
    "neural_network_general": "Neural network (general)",
    "cnn_convolutional": "CNN / convolutional",
    "transformer_attention": "Transformer / attention",
    "classical_ml": "Classical ML",
    "generative_model": "Generative model",
    "reinforcement_learning": "Reinforcement learning",
    "optimization": "Optimization",
    "other": "Other",
}

# Keyword families searched in the reasoning text (lower-cased first).
EMERGING_FAMILIES = {
    "Foundation models / LLMs": (
        r"language.model|large.language|llm\b|foundation.model|gpt\b|bert\b|"
        r"pre.?trained.{0,20}model|generative.pre.?train|instruction.tun|"
        r"chat.model|transformer.model"
    ),
    "Federated learning": (
        r"federated.learn|federated.train|federated.optim|"
        r"federat\w+.aggregat|split.learning"
    ),
    "Agents / agentic AI": (
        r"\bagent\b|agentic|multi.?agent|autonomous.agent|"
        r"tool.?use|tool.?call|planning.agent|llm.agent"
    ),
    "Model distillation": (
        r"distill|knowledge.transfer.{0,20}model|"
        r"teacher.student|student.model|model.compression"
    ),
}

# Classification-code prefixes that mark a candidate publication.
CPC_CANDIDATE = r"^(G06N|G06V|G10L1[0-9]|G10L2[0-9]|G06F18|G06F40|G16H|G05B|G06Q)"
CPC_COUNTRY = r"^(G06N|G06V|G06F|G16H|G05B|G06Q|G10L)"

# Country groups.
EU27 = [
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT",
    "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE",
]
EU10 = ["DE", "FR", "NL", "IT", "IE", "ES", "BE", "SE", "AT", "DK"]

# Yearly AI investment, US private (bn USD) and EU-10 (m EUR), and EU-10 in 2023.
US_INVESTMENT = {
    2010: 1.7, 2011: 2.1, 2012: 2.8, 2013: 3.7, 2014: 6.9, 2015: 12.7, 2016: 17.0,
    2017: 24.6, 2018: 40.4, 2019: 36.0, 2020: 36.8, 2021: 93.5, 2022: 47.4, 2023: 67.2,
}
EU10_INVESTMENT = {
    2015: 29489.83, 2016: 33489.64, 2017: 39014.33, 2018: 46618.71, 2019: 71881.30,
    2020: 85039.71, 2021: 102157.69, 2022: 128565.66, 2023: 126070.91,
}
EU10_INVESTMENT_2023 = {
    "DE": 26629.0, "FR": 30928.0, "NL": 18306.0, "IT": 12049.0, "IE": 7421.0, "ES": 8236.0,
    "BE": 7042.0, "SE": 6785.0, "AT": 4635.0, "DK": 4039.0,
}
COVID_YEARS = [2020, 2021]
REGRESSION_FROM_YEAR = 2015

# Character limits of the text sections.
CLAIM_CHARS, ABSTRACT_CHARS, SHORT_ABSTRACT_CHARS = 800, 600, 800
RAW_CHARS, DISPLAY_CHARS = 200, 300

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
UNIVERSE = struct(doc_id=STRING, year=INT)
CLAIMS_RAW = struct(patent_id=STRING, claim_sequence=STRING, claim_text=STRING)

# The twelve response keys of the full label set, and the nine of the short one.
LABELS = struct(
    is_genuine_ai=BOOL, false_positive_reason=STRING, ai_technique=STRING,
    application_domain=STRING, data_modality=STRING, innovation_orientation=STRING,
    core_ai_task=STRING, contribution_type=STRING, training_paradigm=STRING,
    is_llm_related=BOOL, confidence=STRING, reasoning=STRING,
)
SHORT_LABELS = T.StructType(
    [f for f in LABELS if f.name not in ("data_modality", "core_ai_task", "training_paradigm")]
)
CLASSIFICATION = T.StructType(
    [*UNIVERSE.fields, *LABELS.fields, T.StructField("status", STRING), T.StructField("raw_response", STRING)]
)
LOCALIZED = T.ArrayType(struct(text=STRING, language=STRING))
COUNTRY_LIST = T.ArrayType(struct(country_code=STRING))
PUBLICATIONS = struct(
    publication_number=STRING, application_number=STRING, country_code=STRING, filing_date=INT,
    publication_date=INT, title_localized=LOCALIZED, abstract_localized=LOCALIZED,
    priority_claim=T.ArrayType(
        struct(publication_number=STRING, application_number=STRING, filing_date=INT)
    ),
    cpc=T.ArrayType(struct(code=STRING)), assignee_harmonized=COUNTRY_LIST,
    inventor_harmonized=COUNTRY_LIST,
)
SUMMARY_DIMENSIONS = [
    "ai_technique", "application_domain", "innovation_orientation", "core_ai_task",
    "contribution_type", "training_paradigm", "confidence",
]

# Captions of the technique x domain table.
HEATMAP_TECH_CAPTIONS = {
    "neural_network_general": "Neural network\n(general)",
    "cnn_convolutional": "CNN /\nconvolutional",
    "transformer_attention": "Transformer /\nattention",
    "classical_ml": "Classical ML",
    "generative_model": "Generative\nmodel",
    "speech_audio_tech": "Speech &\naudio",
    "reinforcement_learning": "Reinforcement\nlearning",
    "optimization": "Optimization",
}
HEATMAP_DOMAIN_CAPTIONS = {
    "computer_vision_imaging": "Computer\nvision",
    "nlp_text": "NLP /\ntext",
    "healthcare_medical": "Healthcare",
    "autonomous_systems": "Autonomous\nsystems",
    "ai_methods_infrastructure": "AI methods &\ninfrastructure",
    "consumer_electronics": "Consumer\nelectronics",
    "industrial_manufacturing": "Industrial\n/ mfg.",
    "speech_audio": "Speech\n& audio",
}
