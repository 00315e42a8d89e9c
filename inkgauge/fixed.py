"""Fixed values that results depend on, plus the declared feature lists."""

# Penn tags counted as meaning-bearing.
MEANING_TAGS = (
    "NN", "NNS", "NNP", "NNPS",
    "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
    "JJ", "JJR", "JJS",
    "RB", "RBR", "RBS",
)

# Upper bounds (seconds) of the reserved latency histogram.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0)

# Variables logged for every endpoint, and the metric types.
RESERVED_METRICS = ("_latency", "_count")
METRIC_TYPES = ("scalar", "enum", "value", "counter")

# Readability and text-level feature names.
READABILITY_FEATURES = (
    "flesch_kincaid_grade", "gunning_fog", "coleman_liau_index",
    "smog_index", "ari", "dale_chall",
)
TEXT_FEATURES = ("textual_entropy", "semantic_density")

# Token, entity and tree feature names.
TREE_FEATURES = (
    "num_sentences", "num_tokens", "num_unique_lemmas", "average_token_length",
    "average_sentence_length", "num_entities", "num_noun_chunks", "num_pos_tags",
    "num_distinct_entities", "average_entity_length", "average_noun_chunk_length",
    "max_depth", "avg_branching_factor", "total_nodes", "total_leaves",
    "unique_rules", "tree_complexity", "depth_variability",
)
EXTRA_TREE_FEATURES = ("tree_height_variability",)

# The lexicon's category names, in the order of the feature list.
LEXICON_CATEGORIES = tuple(
    """
    help office dance money wedding domestic_work sleep medical_emergency cold
    hate cheerfulness aggression occupation envy anticipation family vacation
    crime attractive masculine prison health pride dispute nervousness
    government weakness horror swearing_terms leisure suffering royalty wealthy
    tourism furniture school magic beach journalism morning banking
    social_media exercise night kill blue_collar_job art ridicule play computer
    college optimism stealing real_estate home divine sexual fear irritability
    superhero business driving pet childish cooking exasperation religion
    hipster internet surprise reading worship leader independence movement body
    noise eating medieval zest confusion water sports death healing legend
    heroic celebration restaurant violence programming dominant_heirarchical
    military neglect swimming exotic love hiking communication hearing order
    sympathy hygiene weather anonymity trust ancient deception fabric
    air_travel fight dominant_personality music vehicle politeness toy farming
    meeting war speaking listen urban shopping disgust fire tool phone gain
    sound injury sailing rage science work appearance valuable warmth youth
    sadness fun emotional joy affection traveling fashion ugliness lust shame
    torment economics anger politics ship clothing car strength technology
    breaking shape_and_size power white_collar_job animal party terrorism smell
    disappointment poor plant pain beauty timidity philosophy negotiate
    negative_emotion cleaning messaging competing law friends payment
    achievement alcohol liquid feminine weapon children monster ocean giving
    contentment writing rural positive_emotion musical
    """.split()
)

FEATURES = (
    READABILITY_FEATURES + TEXT_FEATURES + TREE_FEATURES + EXTRA_TREE_FEATURES
    + LEXICON_CATEGORIES
)

# Code-point ranges treated as emoji.
EMOJI_RANGES = (
    (0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF),
    (0x2500, 0x2BEF), (0x2702, 0x27B0), (0x24C2, 0x1F251), (0x1F926, 0x1F937),
    (0x10000, 0x10FFFF), (0x2640, 0x2642), (0x2600, 0x2B55), (0x200D, 0x200D),
    (0x23CF, 0x23CF), (0x23E9, 0x23E9), (0x231A, 0x231A), (0xFE0F, 0xFE0F),
    (0x3030, 0x3030),
)

# Literal prefixes of the three generated prompts.
STANDARD_PROMPT = (
    "Generate a quality and detailed middle or highschool essay that directly "
    "addresses the prompt: "
)
DETAILED_PROMPT = """Generate an essay that closely resembles a high-quality, B+ level essay written by a 8th to 12th grade 
    high-school student. The essay should reflect a deep understanding of the topic, with coherent arguments and clear structure. 
    However, to closely mimic human writing, include subtle imperfections typical of a student at this level. These may include 
    - Occasional grammatical errors: Introduce minor grammatical mistakes that a student might make under exam conditions or in a 
    final draft, such as slight misuse of commas,  or occasional awkward phrasing. 
    - Varying sentence structure: Use a mix of simple, compound, and complex sentences, with some variation in fluency to reflect a 
    student's developing writing style. 
    - Personal touch: Include personal opinions, anecdotes, or hypothetical examples where appropriate, to give the essay a unique voice. 
    - Argument depth: While the essay should be well-researched and informed, the depth of argument might not reach the sophistication of 
    a more experienced writer. Arguments should be sound but might lack the nuance a more advanced writer would include. 
    - Conclusion: Ensure the essay has a clear conclusion, but one that might not fully encapsulate all the complexities of the topic, 
    as a student might struggle to tie all threads together neatly. Remember, the goal is to create a piece that balances high-quality 
    content with the authentic imperfections of a human student writer. 
    The essay should be on the following topic:"""
REWRITE_PROMPT = (
    "Rewrite the following student essay by enhancing its structure, vocabulary, "
    "and overall quality. It's important to keep the same tone. Do not change "
    "facts or opinons. Ensure that the content and meaning of the original essay "
    "are preserved. Keep the lengths the same within 50 words. : "
)
