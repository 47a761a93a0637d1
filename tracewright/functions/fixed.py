"""Fixed values that results depend on."""

# Identifiers of record formats, and the marks of log lines.
LOG_MARK = "PY_CONTACT_LOG"
OBSERVATION_SCHEMA = "cmo_emission_observation_v1"
OBSERVATION_SOURCE = "cmo_lua"
OBSERVATION_ID_KIND = "cmo-observation"
EXPORT_SCHEMA = "cmo_combat_id_v1"
DATASET_SCHEMA = "cmo_combat_id_dataset_v1"
FEATURE_SCHEMA = "graph_neighbourhood_features_v1"
PROBABILITY_SCHEMA = "platform_operator_nation_probability_v1"
EXPLANATION_SCHEMA = "llm_explainer_payload_v1"

# Sentences of explanation records, which readers of those compare.
NOTE_LOW = "Top platform probability is below 0.60, so the assignment should be treated as tentative."
NOTE_CLOSE = "The two leading platform hypotheses are separated by less than 0.15 probability."
NOTE_UNKNOWN = "Non-identifying operator-nation labels were excluded; the summary uses the highest-probability positive operator-nation candidate."
ADVICE = [
    "If authorized and tactically safe, engage or retask an active RADAR for range, track, and signature evidence.",
    "Collect another time-separated passive RF observation and improve angle-of-arrival geometry.",
    "Cross-cue independent EO/IR, IFF, or intelligence sources before acting on identity.",
]
WARNING = "Identification is probabilistic; retain human review and do not treat the LLM narrative as new evidence."

# Weights of the linear logit.
FEATURE_WEIGHTS = {
    "supporting_path_count": 0.65,
    "contradicting_path_count": -0.75,
    "mean_source_reliability": 0.80,
    "recency": 0.50,
    "shortest_path_to_platform_class": -0.20,
    "emission_match_score": 1.10,
    "kinematic_match_score": 0.90,
    "contradiction_score": -1.20,
}

# Geography of the distance evidence.
EARTH_RADIUS_KM = 6371.0088
DISTANCE_SCALE_KM = 2000.0
DISTANCE_WEIGHT = 1.0

# Operator nations that identify nobody, in probability records and in graph rows.
UNKNOWN_NATIONS = ["", "unknown", "unk", "n/a", "na", "none", "null", "not specified", "unspecified"]
UNKNOWN_GRAPH_NATIONS = ["", "UNKNOWN", "UNK", "N/A", "NONE"]

# Labels of graph nodes that can and cannot be platforms.
PLATFORM_LABELS = ["PLATFORM", "AIRCRAFT", "CANDIDATEIDENTITY"]
NO_PLATFORM_LABELS = ["COUNTRY", "SENSOR", "OPERATOR", "LOCATION"]

# Predicates by the kind of thing they relate.
PLATFORM_PREDICATES = [
    "HAS_SENSOR", "USES_RADAR", "HAS_EMITTER", "HAS_WEAPON", "HAS_SUBSYSTEM", "HAS_VARIANT", "HAS_PLATFORM", "VARIANT_OF", "OPERATED_BY", "OPERATOR_COUNTRY",
    "SERVICE_WITH", "BASED_AT", "DEPLOYED_TO", "OPERATES_IN", "TYPICAL_SPEED_KT", "MAX_SPEED_KT", "CRUISE_SPEED_KT", "SERVICE_CEILING_M", "TYPICAL_ALTITUDE_M", "HAS_KINEMATIC_PROFILE",
]
SENSOR_PREDICATES = ["HAS_SENSOR", "USES_RADAR", "HAS_EMITTER", "EMITS", "DETECTS", "RADAR_BAND", "HAS_MODE", "USES_FREQUENCY"]
SENSOR_SUBJECT_PREDICATES = ["RADAR_BAND", "HAS_MODE", "USES_FREQUENCY", "EMITS", "DETECTS"]
PLATFORM_OBJECT_PREDICATES = ["HAS_VARIANT", "HAS_PLATFORM", "VARIANT_OF"]
OPERATOR_PREDICATES = ["OPERATED_BY", "SERVICE_WITH"]
COUNTRY_PREDICATES = ["OPERATOR_COUNTRY", "HOME_BASE_COUNTRY"]
LOCATION_PREDICATES = ["LOCATED_IN", "BASED_AT", "DEPLOYED_TO", "OPERATES_IN"]
OTHER_PREDICATES = [
    "IS_A", "ALSO_KNOWN_AS", "NATO_REPORTING_NAME", "PLATFORM_TYPE", "AIRCRAFT_FAMILY", "EMITTER_TYPE", "HAS_TARGET_TYPE", "SUPPORTS_IDENTIFICATION",
    "CONTRADICTS_IDENTIFICATION", "DISTINGUISHES_FROM", "INDICATES",
]
SUPPORT_TYPES = ["SUPPORTS", "FACT", "CLASSIFIED_AS", "EMITTED", "DETECTED_BY"]
VARIANT_TYPES = ["VARIANT_OF", "HAS_VARIANT", "AIRCRAFT_FAMILY"]
EMITTER_VARIANT_TYPES = ["VARIANT_OF", "HAS_VARIANT", "ALSO_KNOWN_AS"]
OPERATOR_TYPES = ["OPERATED_BY", "OPERATOR", "USED_BY", "SERVICE_WITH", "ASSIGNED_TO"]
COUNTRY_TYPES = ["OPERATOR_COUNTRY", "HOME_BASE_COUNTRY"]
COUNTRY_VIA_OPERATOR_TYPES = ["OPERATOR_COUNTRY", "HOME_BASE_COUNTRY", "LOCATED_IN"]
OPERATOR_FACTS = ["OPERATED_BY_AIRCRAFT_MODEL", "AIRCRAFT_MODEL_OPERATED_BY"]
SPEED_FACTS = ["MAX_SPEED_KT", "TYPICAL_SPEED_KT", "CRUISE_SPEED_KT"]
ALTITUDE_FACTS = ["SERVICE_CEILING_M", "MAX_ALTITUDE_M", "TYPICAL_ALTITUDE_M"]

# Words for nations in free text.
NATION_TERMS = {
    "AMERICAN": "United States",
    "UNITED STATES": "United States",
    "US": "United States",
    "U.S.": "United States",
    "U S": "United States",
    "BRITISH": "United Kingdom",
    "UNITED KINGDOM": "United Kingdom",
    "UK": "United Kingdom",
    "INDIAN": "India",
    "INDIA": "India",
    "ROMANIAN": "Romania",
    "ROMANIA": "Romania",
    "RUSSIAN": "Russia",
    "RUSSIA": "Russia",
    "CHINESE": "China",
    "CHINA": "China",
    "FRENCH": "France",
    "FRANCE": "France",
    "GERMAN": "Germany",
    "GERMANY": "Germany",
    "ITALIAN": "Italy",
    "ITALY": "Italy",
    "JAPANESE": "Japan",
    "JAPAN": "Japan",
    "AUSTRALIAN": "Australia",
    "AUSTRALIA": "Australia",
    "CANADIAN": "Canada",
    "CANADA": "Canada",
    "PAKISTANI": "Pakistan",
    "PAKISTAN": "Pakistan",
    "TURKISH": "Turkey",
    "TURKEY": "Turkey",
    "TÜRKIYE": "Türkiye",
    "ISRAELI": "Israel",
    "ISRAEL": "Israel",
    "EGYPTIAN": "Egypt",
    "EGYPT": "Egypt",
    "IRANIAN": "Iran",
    "IRAN": "Iran",
    "IRAQI": "Iraq",
    "IRAQ": "Iraq",
    "SAUDI": "Saudi Arabia",
    "SAUDI ARABIA": "Saudi Arabia",
    "SOUTH KOREAN": "South Korea",
    "REPUBLIC OF KOREA": "South Korea",
    "NORTH KOREAN": "North Korea",
}

# makers' names that are left out of designations: (pattern, family).
MAKERS = [
    (r"(?i)^(?:mikoy[ae]n|mikoyan-gurevich)\s+(mig[-\s]?\d+[a-z0-9-]*)$", "MiG"),
    (r"(?i)^(?:sukhoi)\s+(su[-\s]?\d+[a-z0-9-]*)$", "Su"),
    (r"(?i)^(?:tupolev)\s+(tu[-\s]?\d+[a-z0-9-]*)$", "Tu"),
    (r"(?i)^(?:ilyushin)\s+(il[-\s]?\d+[a-z0-9-]*)$", "Il"),
    (r"(?i)^(?:lockheed martin|lockheed)\s+(f[-\s]?\d+[a-z0-9-]*)$", "F"),
    (r"(?i)^(?:boeing|mcdonnell douglas|douglas)\s+(f[-\s]?\d+[a-z0-9-]*)$", "F"),
    (r"(?i)^(?:northrop grumman|northrop)\s+(f[-\s]?\d+[a-z0-9-]*)$", "F"),
    (r"(?i)^(?:general dynamics)\s+(f[-\s]?\d+[a-z0-9-]*)$", "F"),
    (r"(?i)^(?:eurofighter)\s+(typhoon(?:\s+[a-z0-9.]+)?)$", "Typhoon"),
]

# Relations of the evidence graph for convolutions.
GRAPH_RELATIONS = {
    "observation_detects_emitter": 0,
    "emitter_detected_by_observation": 1,
    "intel_supports_emitter": 2,
    "emitter_supported_by_intel": 3,
    "emitter_installed_on_platform": 4,
    "platform_carries_emitter": 5,
    "observation_precedes_observation": 6,
    "observation_follows_observation": 7,
}

# Centres of nations (latitude, longitude).
CENTROIDS = {
    "belarus": (53.7098, 27.9534),
    "china": (35.8617, 104.1954),
    "france": (46.2276, 2.2137),
    "germany": (51.1657, 10.4515),
    "india": (20.5937, 78.9629),
    "iran": (32.4279, 53.6880),
    "israel": (31.0461, 34.8516),
    "kazakhstan": (48.0196, 66.9237),
    "north korea": (40.3399, 127.5101),
    "pakistan": (30.3753, 69.3451),
    "poland": (51.9194, 19.1451),
    "russia": (61.5240, 105.3188),
    "russian federation": (61.5240, 105.3188),
    "south korea": (35.9078, 127.7669),
    "syria": (34.8021, 38.9968),
    "turkey": (38.9637, 35.2433),
    "ukraine": (48.3794, 31.1656),
    "united kingdom": (55.3781, -3.4360),
    "united kingdom of great britain and northern ireland": (55.3781, -3.4360),
    "united states": (37.0902, -95.7129),
    "united states of america": (37.0902, -95.7129),
    "usa": (37.0902, -95.7129),
}

# Outlines of nations, vertices (latitude, longitude).
BORDERS = {
    "algeria": ((18.97, -8.67), (18.97, 11.99), (37.09, 11.99), (37.09, -8.67)),
    "angola": ((-18.04, 11.67), (-18.04, 24.09), (-4.38, 24.09), (-4.38, 11.67)),
    "azerbaijan": ((38.39, 44.77), (38.39, 50.37), (41.91, 50.37), (41.91, 44.77)),
    "bangladesh": ((20.74, 88.03), (20.74, 92.67), (26.63, 92.67), (26.63, 88.03)),
    "belarus": ((51.25, 23.18), (52.15, 31.78), (56.17, 28.15), (55.85, 23.50)),
    "bulgaria": ((41.24, 22.36), (41.24, 28.61), (44.22, 28.61), (44.22, 22.36)),
    "china": ((18.16, 73.50), (18.16, 134.77), (53.56, 134.77), (53.56, 73.50)),
    "cuba": ((19.83, -84.95), (19.83, -74.13), (23.27, -74.13), (23.27, -84.95)),
    "czech republic": ((48.55, 12.09), (48.55, 18.86), (51.06, 18.86), (51.06, 12.09)),
    "czechia": ((48.55, 12.09), (48.55, 18.86), (51.06, 18.86), (51.06, 12.09)),
    "czechoslovakia": ((47.73, 12.09), (47.73, 22.57), (51.06, 22.57), (51.06, 12.09)),
    "democratic people's republic of korea": ((37.67, 124.18), (37.67, 130.67), (43.01, 130.67), (43.01, 124.18)),
    "east germany": ((50.20, 9.92), (50.20, 15.04), (54.98, 15.04), (54.98, 9.92)),
    "egypt": ((22.00, 24.70), (22.00, 36.90), (31.67, 36.90), (31.67, 24.70)),
    "eritrea": ((12.35, 36.43), (12.35, 43.13), (18.02, 43.13), (18.02, 36.43)),
    "ethiopia": ((3.40, 32.99), (3.40, 47.99), (14.89, 47.99), (14.89, 32.99)),
    "germany": ((47.27, 5.87), (47.27, 15.04), (55.06, 15.04), (55.06, 5.87)),
    "hungary": ((45.74, 16.11), (45.74, 22.90), (48.59, 22.90), (48.59, 16.11)),
    "india": ((6.75, 68.11), (6.75, 97.40), (35.67, 97.40), (35.67, 68.11)),
    "indonesia": ((-11.01, 95.01), (-11.01, 141.02), (6.08, 141.02), (6.08, 95.01)),
    "iran": ((25.06, 44.03), (25.06, 63.33), (39.78, 63.33), (39.78, 44.03)),
    "iraq": ((29.06, 38.79), (29.06, 48.58), (37.38, 48.58), (37.38, 38.79)),
    "israel": ((29.45, 34.27), (29.45, 35.90), (33.34, 35.90), (33.34, 34.27)),
    "kazakhstan": ((40.56, 46.49), (45.00, 87.32), (55.44, 84.95), (55.38, 46.49)),
    "libya": ((19.50, 9.32), (19.50, 25.15), (33.17, 25.15), (33.17, 9.32)),
    "malaysia": ((0.85, 99.64), (0.85, 119.27), (7.36, 119.27), (7.36, 99.64)),
    "moldova": ((45.47, 26.62), (45.47, 30.16), (48.49, 30.16), (48.49, 26.62)),
    "mongolia": ((41.58, 87.75), (41.58, 119.93), (52.15, 119.93), (52.15, 87.75)),
    "myanmar": ((9.78, 92.19), (9.78, 101.17), (28.55, 101.17), (28.55, 92.19)),
    "north korea": ((37.67, 124.18), (37.67, 130.67), (43.01, 130.67), (43.01, 124.18)),
    "peru": ((-18.35, -81.33), (-18.35, -68.65), (-0.04, -68.65), (-0.04, -81.33)),
    "poland": ((49.00, 14.12), (49.00, 24.15), (54.84, 24.15), (54.84, 14.12)),
    "romania": ((43.62, 20.26), (43.62, 29.70), (48.27, 29.70), (48.27, 20.26)),
    "russia": ((41.19, 19.64), (41.19, 180.00), (81.86, 180.00), (81.86, 19.64)),
    "russian federation": ((41.19, 19.64), (41.19, 180.00), (81.86, 180.00), (81.86, 19.64)),
    "serbia": ((42.23, 18.84), (42.23, 23.01), (46.19, 23.01), (46.19, 18.84)),
    "slovakia": ((47.73, 16.83), (47.73, 22.57), (49.61, 22.57), (49.61, 16.83)),
    "south yemen": ((12.11, 42.55), (12.11, 54.54), (18.99, 54.54), (18.99, 42.55)),
    "soviet union": ((35.14, 19.64), (35.14, 180.00), (81.86, 180.00), (81.86, 19.64)),
    "sudan": ((8.68, 21.81), (8.68, 38.61), (22.23, 38.61), (22.23, 21.81)),
    "syria": ((32.31, 35.70), (32.31, 42.38), (37.32, 42.38), (37.32, 35.70)),
    "turkmenistan": ((35.13, 52.44), (35.13, 66.71), (42.80, 66.71), (42.80, 52.44)),
    "ukraine": ((44.39, 22.14), (45.35, 40.23), (52.38, 40.23), (52.38, 22.14)),
    "united states": ((24.52, -124.77), (24.52, -66.95), (49.38, -66.95), (49.38, -124.77)),
    "united states of america": ((24.52, -124.77), (24.52, -66.95), (49.38, -66.95), (49.38, -124.77)),
    "usa": ((24.52, -124.77), (24.52, -66.95), (49.38, -66.95), (49.38, -124.77)),
    "uzbekistan": ((37.18, 55.99), (37.18, 73.13), (45.59, 73.13), (45.59, 55.99)),
    "venezuela": ((0.65, -73.35), (0.65, -59.80), (12.20, -59.80), (12.20, -73.35)),
    "vietnam": ((8.18, 102.14), (8.18, 109.46), (23.39, 109.46), (23.39, 102.14)),
    "yemen": ((12.11, 42.55), (12.11, 54.54), (18.99, 54.54), (18.99, 42.55)),
    "yugoslavia": ((40.85, 13.49), (40.85, 23.04), (46.88, 23.04), (46.88, 13.49)),
}


# Upper-case names that count as countries.
COUNTRIES = [
    "AFGHANISTAN", "ALBANIA", "ALGERIA", "ANDORRA", "ANGOLA", "ANTIGUA AND BARBUDA", "ARGENTINA", "ARMENIA", "AUSTRALIA", "AUSTRIA", "AZERBAIJAN",
    "BAHAMAS", "BAHRAIN", "BANGLADESH", "BARBADOS", "BELARUS", "BELGIUM", "BELIZE", "BENIN", "BHUTAN", "BOLIVIA", "BOLIVIA (PLURINATIONAL STATE OF)",
    "BOSNIA AND HERZEGOVINA", "BOTSWANA", "BRAZIL", "BRUNEI", "BRUNEI DARUSSALAM", "BULGARIA", "BURKINA FASO", "BURUNDI", "CABO VERDE", "CAPE VERDE",
    "CAMBODIA", "CAMEROON", "CANADA", "CENTRAL AFRICAN REPUBLIC", "CHAD", "CHILE", "CHINA", "COLOMBIA", "COMOROS", "CONGO",
    "CONGO, DEMOCRATIC REPUBLIC OF THE", "CONGO, THE DEMOCRATIC REPUBLIC OF THE", "COSTA RICA", "COTE D'IVOIRE", "CÔTE D'IVOIRE", "CROATIA", "CUBA",
    "CYPRUS", "CZECH REPUBLIC", "CZECHIA", "DEMOCRATIC PEOPLE'S REPUBLIC OF KOREA", "DEMOCRATIC REPUBLIC OF THE CONGO", "DENMARK", "DJIBOUTI",
    "DOMINICA", "DOMINICAN REPUBLIC", "ECUADOR", "EGYPT", "EL SALVADOR", "EQUATORIAL GUINEA", "ERITREA", "ESTONIA", "ESWATINI", "ETHIOPIA", "FIJI",
    "FINLAND", "FRANCE", "GABON", "GAMBIA", "GEORGIA", "GERMANY", "GHANA", "GREECE", "GRENADA", "GUATEMALA", "GUINEA", "GUINEA-BISSAU", "GUYANA",
    "HAITI", "HOLY SEE", "HONDURAS", "HUNGARY", "ICELAND", "INDIA", "INDONESIA", "IRAN", "IRAN (ISLAMIC REPUBLIC OF)", "IRAQ", "IRELAND", "ISRAEL",
    "ITALY", "IVORY COAST", "JAMAICA", "JAPAN", "JORDAN", "KAZAKHSTAN", "KENYA", "KIRIBATI", "KOREA, DEMOCRATIC PEOPLE'S REPUBLIC OF",
    "KOREA, REPUBLIC OF", "KOSOVO", "KUWAIT", "KYRGYZSTAN", "LAO PEOPLE'S DEMOCRATIC REPUBLIC", "LAOS", "LATVIA", "LEBANON", "LESOTHO", "LIBERIA",
    "LIBYA", "LIECHTENSTEIN", "LITHUANIA", "LUXEMBOURG", "MADAGASCAR", "MALAWI", "MALAYSIA", "MALDIVES", "MALI", "MALTA", "MARSHALL ISLANDS",
    "MAURITANIA", "MAURITIUS", "MEXICO", "MICRONESIA", "MICRONESIA (FEDERATED STATES OF)", "MOLDOVA", "MOLDOVA, REPUBLIC OF", "MONACO", "MONGOLIA",
    "MONTENEGRO", "MOROCCO", "MOZAMBIQUE", "MYANMAR", "NAMIBIA", "NAURU", "NEPAL", "NETHERLANDS", "NEW ZEALAND", "NICARAGUA", "NIGER", "NIGERIA",
    "NORTH KOREA", "NORTH MACEDONIA", "NORWAY", "OMAN", "PAKISTAN", "PALAU", "PALESTINE", "PALESTINE, STATE OF", "PANAMA", "PAPUA NEW GUINEA",
    "PARAGUAY", "PERU", "PHILIPPINES", "POLAND", "PORTUGAL", "QATAR", "REPUBLIC OF KOREA", "REPUBLIC OF MOLDOVA", "ROMANIA", "RUSSIA",
    "RUSSIAN FEDERATION", "RWANDA", "SAINT KITTS AND NEVIS", "SAINT LUCIA", "SAINT VINCENT AND THE GRENADINES", "SAMOA", "SAN MARINO",
    "SAO TOME AND PRINCIPE", "SAUDI ARABIA", "SENEGAL", "SERBIA", "SEYCHELLES", "SIERRA LEONE", "SINGAPORE", "SLOVAKIA", "SLOVENIA",
    "SOLOMON ISLANDS", "SOMALIA", "SOUTH AFRICA", "SOUTH KOREA", "SOUTH SUDAN", "SPAIN", "SRI LANKA", "SUDAN", "SURINAME", "SWEDEN", "SWITZERLAND",
    "SYRIA", "SYRIAN ARAB REPUBLIC", "TAIWAN", "TAJIKISTAN", "TANZANIA", "TANZANIA, UNITED REPUBLIC OF", "THAILAND", "TIMOR-LESTE", "TOGO", "TONGA",
    "TRINIDAD AND TOBAGO", "TUNISIA", "TURKEY", "TÜRKIYE", "TURKMENISTAN", "TUVALU", "UGANDA", "UKRAINE", "UNITED ARAB EMIRATES", "UNITED KINGDOM",
    "UNITED KINGDOM OF GREAT BRITAIN AND NORTHERN IRELAND", "UNITED REPUBLIC OF TANZANIA", "UNITED STATES", "UNITED STATES OF AMERICA", "URUGUAY",
    "USA", "UZBEKISTAN", "VANUATU", "VATICAN CITY", "VENEZUELA", "VENEZUELA (BOLIVARIAN REPUBLIC OF)", "VIET NAM", "VIETNAM", "WESTERN SAHARA",
    "YEMEN", "ZAMBIA", "ZIMBABWE",
]


def default_countries() -> list[str]:
    """Names that count as countries; operators take another list as a parameter."""
    return list(COUNTRIES)
