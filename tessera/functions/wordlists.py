"""Word lists and names that results depend on."""

LEGAL_SUFFIXES = (
    "ltd", "limited", "pvt", "private", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "llp", "plc", "gmbh", "sa", "bv", "srl",
    "spa", "services", "solutions", "enterprises", "group", "holdings", "international", "tech", "technologies", "industries", "pvt ltd",
    "private limited", "co ltd", "co limited", "inc corp",
)
ADDRESS_ABBREVIATIONS = (
    ("road", "rd"), ("street", "st"), ("avenue", "ave"), ("lane", "ln"), ("highway", "hwy"), ("apartment", "apt"),
    ("building", "bldg"), ("suite", "ste"), ("floor", "fl"), ("drive", "dr"), ("boulevard", "blvd"), ("post office", "po"),
    ("opposite", "opp"), ("near", "nr"), ("sector", "sec"), ("phase", "ph"), ("block", "blk"), ("number", "no"),
)
NAME_STOPWORDS = (
    "company", "store", "shop", "india", "private", "limited", "restaurant", "services", "solutions", "enterprises", "group", "holdings",
    "international", "tech", "technologies", "industries", "ltd", "pvt", "inc", "corp", "llc", "co", "and", "the", "for", "center", "centre", "mart",
    "plaza", "traders",
)
ADDRESS_STOPWORDS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "highway", "hwy", "apartment", "apt", "building", "bldg", "floor", "fl", "suite",
    "ste", "house", "h", "no", "number", "num", "opposite", "opp", "near", "post", "office", "po", "district", "dist", "city", "state", "country",
    "india", "usa", "united", "states",
)
MODIFIERS = (
    "west", "east", "north", "south", "central", "holdings", "holding", "exports", "export", "services", "service", "international", "industries",
    "logistics", "properties", "realty", "finance", "financial", "motors",
)
STREET_STOPWORDS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "blvd", "boulevard", "way", "rue", "court", "ct", "place", "pl",
    "nouvelle", "aquitaine", "gironde", "france", "india", "odisha", "orissa", "khurda", "khordha", "bhubaneswar", "texas", "tyler", "tx", "state",
    "country", "city", "near", "opp", "opposite", "behind", "beside", "floor", "fl", "suite", "ste", "apt", "apartment", "unit", "bldg", "building",
)
#: Cells that the reference reader takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
FEATURES = [
    "name_fuzz_ratio", "name_partial_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_wratio", "name_jaro_winkler", "name_basic_exact",
    "name_nosuf_exact", "name_sorted_exact", "name_first_token_exact", "name_last_token_exact", "name_token_jaccard", "name_common_tokens",
    "name_len_diff", "name_len_ratio", "name_abbr_match", "addr_fuzz_ratio", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_jaro_winkler",
    "addr_basic_exact", "addr_token_jaccard", "addr_common_tokens", "addr_digits_common", "addr_digits_jaccard", "postal_code_exact",
    "house_num_exact", "addr_len_diff", "addr_len_ratio", "addr_missing", "country_exact", "name_sim_x_addr_sim", "name_sim_x_country",
    "addr_sim_x_country", "name_exact_and_addr_high", "name_high_and_postal_match", "name_nosuf_exact_and_addr_sim", "is_s2", "is_s3",
]
