"""Word lists, rules and weights, all of this project's own choosing and all overridable by parameter."""

#: Words without meaning of their own.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "das", "de", "der", "des", "die", "ein", "el", "en", "et", "for", "from", "has", "in", "is", "it", "la", "le", "les", "of", "on", "or", "that", "the", "this", "to", "und", "was", "were", "with", "y")
#: Single characters that are words.
PROTECTED = ("c", "r")
#: Characters that become ASCII, one for one.
ASCII_FROM, ASCII_TO = "–—−‐‑×‘’“”", "-----x''\"\""
#: Greek letters that become words.
GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("λ", "lambda"), ("μ", "mu"), ("σ", "sigma"), ("ω", "omega"))
#: Short words that a search keeps.
SHORT_KEYWORDS = ("ai", "ml", "ir", "nlp", "db")

#: Entities by type: words or phrases, as patterns over whole words; the first that fits at a place counts, so longer
#: ones stand before those that they begin with. Fixed values of this project, drawn from several fields of research.
METHODS = (
    "analysis of variance", "autoregressive models?", "bayesian inference", "bootstrapping", "case[- ]control stud(?:y|ies)", "cohort stud(?:y|ies)", "content analysis", "crossover trials?",
    "density functional theory", "discrete choice experiments?", "electrophoresis", "ethnograph(?:y|ies)", "factor analysis", "finite element analysis", "finite differences?", "flow cytometry", "focus groups?",
    "fourier transforms?", "grounded theory", "instrumental variables?", "kriging", "latent class analysis", "life cycle assessment", "linear programming", "longitudinal stud(?:y|ies)", "mass spectrometry",
    "meta-?analysis", "microarrays?", "molecular dynamics", "multilevel models?", "nuclear magnetic resonance", "path analysis", "propensity scores?", "qualitative interviews?", "radiocarbon dating",
    "randomi[sz]ed controlled trials?", "remote sensing", "semi-?structured interviews?", "sensitivity analysis", "stratified sampling", "structural equation models?", "survival analysis", "systematic reviews?",
    "thematic analysis", "time series analysis", "transfer learning", "variational inference", "wavelet transforms?", "x-ray diffraction", "licensed +under +[a-z]+",
)
TASKS = (
    "anomaly detection", "automatic speech recognition", "change detection", "code completion", "coreference resolution", "credit scoring", "demand forecasting", "dialogue generation", "disease diagnosis",
    "drug discovery", "entity linking", "face recognition", "fraud detection", "image captioning", "image segmentation", "information extraction", "intrusion detection", "keyphrase extraction", "language identification",
    "land cover mapping", "link prediction", "machine translation", "object tracking", "optical character recognition", "parsing", "path planning", "pose estimation", "predictive maintenance", "protein folding",
    "question answering", "record linkage", "risk assessment", "route planning", "scheduling", "sentiment analysis", "spam filtering", "speaker identification", "summari[sz]ation", "text classification",
    "text simplification", "topic detection", "traffic prediction", "weather forecasting", "word sense disambiguation", "[a-z]{3,}ing +(?:of|the|and)",
)
DOMAINS = (
    "agronomy", "archaeology", "astronomy", "astrophysics", "behaviou?ral economics", "biodiversity", "cardiology", "climatology", "cognitive science", "criminology", "dermatology", "developmental psychology",
    "ecology", "econometrics", "education research", "endocrinology", "environmental science", "epidemiology", "forestry", "genomics", "geology", "hydrology", "immunology", "international law", "labou?r economics",
    "linguistics", "logistics", "materials science", "meteorology", "microbiology", "nephrology", "neuroscience", "nursing", "nutrition", "oceanography", "oncology", "organi[sz]ational behaviou?r", "particle physics",
    "pediatrics", "pharmacology", "philology", "political science", "proteomics", "public health", "renewable energy", "seismology", "sociology", "supply chains?", "toxicology", "urban planning", "veterinary medicine",
    "volcanology", "zoology", "mail[0-9]",
)
DATASETS = (
    "american community survey", "arabidopsis genome", "british national corpus", "common crawl", "corine land cover", "demographic and health surveys?", "era5", "eurobarometer", "fluxnet", "framingham heart study",
    "gaia dr[0-9]", "gene expression omnibus", "global burden of disease", "google books ngrams?", "gutenberg corpus", "human protein atlas", "landsat", "libri ?speech", "medline", "modis", "national health interview survey",
    "open ?street ?map", "panel study of income dynamics", "project gutenberg", "protein data bank", "sentinel-[0-9]", "sloan digital sky survey", "uk biobank", "universal dependencies", "wikidata", "world values survey",
    "[a-z]+ +(?:corpus|data ?set|benchmark)", "v[0-9]+", "version +[0-9]+",
)
ALGORITHMS = (
    "a-star search", "ada ?boost", "ant colony optimi[sz]ation", "apriori", "backpropagation", "bellman-ford", "branch and bound", "conjugate gradients?", "decision trees?", "dijkstra(?:'s algorithm)?", "dynamic time warping",
    "expectation[- ]maximi[sz]ation", "gaussian processes", "genetic algorithms?", "gibbs sampling", "gradient boosting", "gradient descent", "hidden markov models?", "k-means", "k-nearest neighbou?rs", "kalman filters?",
    "knuth-morris-pratt", "levenberg-marquardt", "locality[- ]sensitive hashing", "metropolis-hastings", "min-?hash", "naive bayes", "newton-raphson", "particle filters?", "q-learning", "quicksort", "random forests?",
    "random walks?", "simplex method", "simulated annealing", "singular value decomposition", "support vector machines?", "tabu search", "union-find", "viterbi(?: decoding)?",
)
#: (entity type, flags, pattern of whole words).
ENTITY_RULES = (
    ("METHOD", "(?i)", "|".join(METHODS)),
    ("TASK", "(?i)", "|".join(TASKS)),
    ("DOMAIN", "(?i)", "|".join(DOMAINS)),
    ("DATASET", "(?i)", "|".join(DATASETS)),
    ("ALGORITHM", "(?i)", "|".join(ALGORITHMS)),
    ("ALGORITHM", "", "[A-Z]{3,}[0-9]*"),
)
#: Whole words by which the relationship classifier tells methods, objections and advances. This project's own choice.
METHOD_WORDS = (
    "ablation", "annealing", "annotation", "bayesian", "bootstrap", "chromatography", "classification", "clustering", "crossover", "crystallography", "ethnography", "factorial", "interviews", "interpolation",
    "longitudinal", "meta-analysis", "microscopy", "optimisation", "optimization", "parsing", "placebo", "questionnaire", "randomised", "randomized", "regression", "sampling", "sequencing", "simulation",
    "spectroscopy", "survey", "tomography", "triangulation",
)
CONTRADICT_WORDS = ("contradicts", "contrary", "disagree", "disputed", "fails", "flawed", "implausible", "inconsistent", "invalid", "misleading", "overstated", "refutes", "rejects", "retracted", "unsupported", "wrongly")
EXTEND_WORDS = ("accelerates", "advances", "broadens", "builds", "complements", "deepens", "enhanced", "extends", "extension", "generalises", "generalizes", "improves", "novel", "outperforms", "refines", "scales", "supersedes")
#: Venue scores by lower-cased name; longest key first, then by name. Fixed values of this project: a rough order of
#: venues of several fields, from general journals and leading conferences to preprints.
VENUES = {
    "nature": 0.98, "science": 0.98, "cell": 0.96, "the lancet": 0.97, "new england journal of medicine": 0.98, "jama": 0.95, "bmj": 0.93, "pnas": 0.93, "proceedings of the national academy of sciences": 0.93,
    "nature communications": 0.9, "science advances": 0.9, "elife": 0.86, "plos biology": 0.86, "plos one": 0.66, "scientific reports": 0.64, "ieee access": 0.6, "heliyon": 0.5,
    "physical review letters": 0.93, "astrophysical journal": 0.86, "journal of the american chemical society": 0.92, "angewandte chemie": 0.91, "geophysical research letters": 0.82, "water resources research": 0.8,
    "american economic review": 0.95, "econometrica": 0.95, "quarterly journal of economics": 0.95, "american sociological review": 0.92, "american political science review": 0.92, "psychological review": 0.92, "cognition": 0.82,
    "management science": 0.88, "organization science": 0.87, "research policy": 0.84, "annals of statistics": 0.91, "biometrika": 0.89, "annals of mathematics": 0.96, "inventiones mathematicae": 0.94,
    "journal of the acm": 0.93, "communications of the acm": 0.84, "acm computing surveys": 0.9, "acm transactions": 0.82, "ieee transactions": 0.82, "journal of machine learning research": 0.9, "machine learning journal": 0.84,
    "neurips": 0.93, "icml": 0.92, "iclr": 0.92, "aaai": 0.85, "ijcai": 0.84, "uai": 0.8, "aistats": 0.8, "acl": 0.9, "emnlp": 0.88, "naacl": 0.85, "coling": 0.76, "lrec": 0.68, "interspeech": 0.74, "icassp": 0.74,
    "cvpr": 0.92, "iccv": 0.91, "eccv": 0.89, "miccai": 0.8, "siggraph": 0.9, "chi": 0.88, "uist": 0.84, "cscw": 0.82, "sigmod": 0.91, "vldb": 0.91, "icde": 0.85, "edbt": 0.76, "kdd": 0.89, "wsdm": 0.83, "sigir": 0.88, "cikm": 0.77, "ecir": 0.7,
    "osdi": 0.92, "sosp": 0.92, "nsdi": 0.9, "usenix atc": 0.82, "eurosys": 0.84, "stoc": 0.91, "focs": 0.91, "soda": 0.88, "popl": 0.9, "pldi": 0.9, "oopsla": 0.84, "icse": 0.88, "fse": 0.85, "isca": 0.88, "micro": 0.86, "ndss": 0.86, "crypto": 0.87,
    "frontiers in": 0.58, "applied sciences": 0.52, "workshop": 0.48, "technical report": 0.42, "thesis": 0.4, "preprint": 0.38, "arxiv": 0.4, "biorxiv": 0.4, "medrxiv": 0.38, "ssrn": 0.38, "blog": 0.15,
}
VENUE_DEFAULT = 0.5

BM25_K1, BM25_B = 1.5, 0.75
IDF_FLOOR = 1e-4
NEURAL_WEIGHTS = {"neural": 0.30, "bm25": 0.25, "cosine": 0.15, "citation": 0.20, "recency": 0.10}
LEXICAL_WEIGHTS = {"bm25": 0.35, "cosine": 0.25, "citation": 0.25, "recency": 0.15}
FALLBACK_WEIGHTS = {"relevance": 0.45, "citation": 0.30, "recency": 0.25}
