"""Word lists, lookup tables, constants and patterns.

Everything in this module is a fixed value: results only agree with the
established behaviour when these agree. All of them are defaults; operators
take them as parameters.
"""

# ---- importance and scoring (fixed values) ---------------------------------
MEMORY_TYPES = ["episodic", "semantic", "identity", "procedural", "concept"]
STATES = ["active", "reinforced", "semantic_candidate", "dormant", "decaying", "archived", "forgotten"]
INACTIVE_STATES = ["archived", "forgotten"]
REVIVABLE_STATES = ["dormant", "decaying", "archived", "forgotten"]
SCORE_NAMES = ["future_utility", "identity_impact", "emotional_salience", "reinforcement", "temporal_persistence"]
IMPORTANCE_WEIGHTS = {
    "future_utility": 0.30, "identity_impact": 0.25, "emotional_salience": 0.15,
    "reinforcement": 0.15, "temporal_persistence": 0.15,
}
TYPE_BASE = {"procedural": 0.85, "identity": 0.80, "semantic": 0.70, "episodic": 0.50}
TYPE_DECAY = {"procedural": 0.02, "identity": 0.01, "semantic": 0.05, "episodic": 0.15}
TYPE_PRIORITY = {"identity": 1.00, "concept": 0.90, "procedural": 0.80, "semantic": 0.65, "episodic": 0.50}
# Scores used when an external score text cannot be parsed.
TYPE_DEFAULT_SCORES = {
    "identity": {"base": 0.75, "identity_impact": 0.85},
    "semantic": {"base": 0.65, "future_utility": 0.80},
    "procedural": {"base": 0.80, "temporal_persistence": 0.90},
    "episodic": {"base": 0.45, "emotional_salience": 0.70},
}

HIGH_UTILITY = [
    "goal", "plan", "objective", "target", "strategy", "building", "creating", "developing", "learning",
    "skill", "expertise", "knowledge", "career", "project", "initiative", "startup", "company",
    "investment", "growth", "scale", "optimize",
]
LOW_IMPORTANCE = [
    "maybe", "could", "might", "probably", "hello", "thanks", "bye", "ok", "sure", "weather", "today",
    "now", "currently",
]
IDENTITY_WORDS = [
    "i am", "i'm", "my personality", "i believe", "my values", "my passion", "my dream", "prefer", "love",
    "hate", "always", "never", "characteristic", "trait",
]
EMOTIONAL_WORDS = [
    "excited", "frustrated", "angry", "sad", "happy", "devastated", "thrilled", "worried", "anxious",
    "proud", "ashamed", "motivated", "love", "hate", "fear", "hope", "accomplish", "achievement",
    "success", "failure",
]
PERSISTENCE_WORDS = [
    "always", "never", "forever", "permanent", "fundamental", "core", "essential", "critical", "long-term",
    "architecture", "foundation", "base",
]
EMPHATIC_WORDS = ["definitely", "always", "never", "absolutely", "must", "essential"]
PRONOUN_MARKS = [" i ", "i'm", "i'm"]  # the contraction counts twice

INGEST_HIGH = [
    "prefer", "like", "dislike", "hate", "love", "goal", "dream", "passionate", "interested", "building",
    "creating", "never", "always", "important", "critical",
]
INGEST_LOW = ["maybe", "could", "might", "hello", "hi", "bye", "thanks", "ok", "cool", "nice"]
SPECIFICITY_MARKS = [["technology", "tool"], ["when", "time"], ["because", "reason"], ["specific", "exactly"]]

ID_NAMESPACE = "2f1a9e2a-3c9a-4a5b-8f1e-8b6a2c9d4e10"

# ---- decay and lifecycle (fixed values) ------------------------------------
BASE_DECAY = {"identity": 0.002, "concept": 0.006, "procedural": 0.012, "semantic": 0.02, "episodic": 0.05}
EPISODIC_LOW_DECAY, EPISODIC_LOW_IMPORTANCE = 0.12, 0.25
FALLBACK_DECAY = 0.05
TRANSITIONS = {
    "active": ["reinforced", "dormant", "decaying"],
    "reinforced": ["active", "semantic_candidate", "dormant", "decaying"],
    "semantic_candidate": ["archived", "active", "decaying"],
    "dormant": ["active", "decaying", "archived"],
    "decaying": ["archived", "active"],
    "archived": ["active", "forgotten"],
    "forgotten": ["active"],
}
TRANSITION_STRENGTH = {
    "active": 0.2, "reinforced": 0.1, "semantic_candidate": 0.05, "dormant": -0.1, "decaying": -0.2,
    "archived": -0.05, "forgotten": -0.15,
}
IDLE_DAYS = {"active": 30, "reinforced": 30, "dormant": 60, "decaying": 90, "archived": 180}
WEAKEN_AT, ARCHIVE_AT, FORGET_AT, FORGET_MIN_DAYS = 0.55, 0.30, 0.10, 180
REVIVE_UTILITY, REVIVE_BOOST = 0.55, 0.25
RETRIEVAL_MIN_STRENGTH, RETRIEVAL_MAX_ENTROPY = 0.15, 0.85

# ---- recall, packing, composition (fixed values) ---------------------------
UTILITY_WEIGHTS = {
    "goal_alignment": 0.30, "identity_alignment": 0.20, "concept_relevance": 0.20, "importance": 0.10,
    "reinforcement": 0.10, "confidence": 0.05, "recency": 0.05,
}
REASON_LABELS = {
    "goal_alignment": "matches the current goal",
    "identity_alignment": "aligns with the user's identity profile",
    "concept_relevance": "relates to a relevant concept",
    "importance": "has high cognitive importance",
    "reinforcement": "has been reinforced through repeated use",
    "confidence": "is a stable, well-established memory",
    "recency": "is recent",
}
CANDIDATE_POOL, MIN_UTILITY = 200, 0.15
RECALL_BUDGET, COMPOSE_BUDGET, RETRIEVAL_BUDGET = 1000, 600, 2000
DEDUP_AT, MERGE_AT, CONTRADICT_AT, DUPLICATE_AT = 0.80, 0.40, 0.50, 0.40
GENERALIZE_AT, TRAIT_DUPLICATE_AT, REDUNDANT_AT, CLUSTER_AT, CENTROID_MERGE_AT = 0.25, 0.50, 0.85, 0.75, 0.85
MAX_FRAGMENTS = 4
QUALITY_WEIGHTS = {
    "coverage": 0.25, "non_redundancy": 0.15, "identity_alignment": 0.20, "goal_alignment": 0.20,
    "reasoning": 0.10, "non_contradiction": 0.10,
}
ENTROPY_WEIGHTS = {"redundancy": 0.30, "conflicts": 0.25, "fragmentation": 0.20, "obsolete": 0.25}
HEALTH_WEIGHTS = {
    "duplicate": 0.15, "archive": 0.10, "forgotten": 0.10, "strength": 0.25, "entropy": 0.25, "graph": 0.15,
}

STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "i", "me", "my", "we", "our", "you",
    "your", "it", "its", "this", "that", "to", "of", "in", "on", "for", "with", "and", "or", "but", "so",
    "if", "do", "does", "did", "can", "could", "should", "would", "will", "shall", "help", "please", "about",
    "how", "what", "why", "when", "where", "who", "user", "users",
]

# ---- query understanding (fixed values) ------------------------------------
DEFAULT_GOAL = "general_assistance"
GOAL_SIGNALS = {
    "system_design": [
        (r"\bsystem design\b", 1.0), (r"\barchitect(ure|ing)?\b", 0.8), (r"\bscal(e|ing|ability)\b", 0.6),
        (r"\bmicroservices?\b", 0.6), (r"\bload balanc\w*\b", 0.6), (r"\bdatabase (schema|design)\b", 0.6),
        (r"\bdesign (a|the|my) backend\b", 0.9), (r"\bhigh[- ]level design\b", 0.8),
        (r"\bbuild (a|an|the) (backend|api|service|platform)\b", 0.5),
    ],
    "interview_preparation": [
        (r"\binterview(s|ing)?\b", 1.0), (r"\bwhiteboard\b", 0.5), (r"\bleet ?code\b", 0.6),
        (r"\bmock interview\b", 0.9), (r"\bhiring (process|round)\b", 0.5),
        (r"\btomorrow\b.*\binterview\b", 0.3), (r"\bprep(are|aring)? for\b", 0.3),
    ],
    "debugging": [
        (r"\bdebug(ging)?\b", 1.0), (r"\bfix (this|the|my) (bug|error|issue)\b", 0.9), (r"\berror\b", 0.5),
        (r"\bexception\b", 0.5), (r"\bstack trace\b", 0.7), (r"\bnot working\b", 0.5),
        (r"\bcrash(ing|es)?\b", 0.6), (r"\bwhy (is|does|isn't|doesn't)\b", 0.3),
    ],
    "learning": [
        (r"\bexplain\b", 0.6), (r"\blearn(ing)?\b", 0.8), (r"\bhow does .* work\b", 0.7), (r"\bwhat is\b", 0.4),
        (r"\bunderstand(ing)?\b", 0.5), (r"\bteach me\b", 0.8), (r"\btutorial\b", 0.5),
    ],
    "career_planning": [
        (r"\bcareer\b", 0.9), (r"\bpromotion\b", 0.7), (r"\bjob (offer|search|hunt)\b", 0.7),
        (r"\bresume|cv\b", 0.6), (r"\bnegotiat\w* (salary|offer)\b", 0.7),
        (r"\bstaff engineer|principal engineer|senior engineer\b", 0.6),
    ],
    "startup_ideation": [
        (r"\bstartup\b", 1.0), (r"\bbrainstorm\b", 0.6), (r"\bbusiness idea\b", 0.8), (r"\bfounder\b", 0.6),
        (r"\bmvp\b", 0.5), (r"\bproduct idea\b", 0.7), (r"\braise (funding|capital)\b", 0.6),
    ],
    "research": [
        (r"\bresearch\b", 0.9), (r"\bcompare\b", 0.4), (r"\bstate of the art\b", 0.7), (r"\bliterature\b", 0.6),
        (r"\btrade[- ]?offs?\b", 0.5), (r"\bpros and cons\b", 0.5),
    ],
    "code_review": [
        (r"\bcode review\b", 1.0), (r"\breview (this|my) code\b", 0.9), (r"\brefactor\b", 0.6),
        (r"\bclean(ing)? up\b", 0.4), (r"\bbest practices?\b", 0.4),
    ],
    "optimization": [
        (r"\boptimi[sz]e\b", 0.9), (r"\bperformance\b", 0.6), (r"\blatency\b", 0.6), (r"\bfaster\b", 0.5),
        (r"\breduce (cost|memory|latency)\b", 0.6), (r"\bbottleneck\b", 0.6),
    ],
    "purchase_decision": [
        (r"\bbuy\b", 0.8), (r"\bpurchase\b", 0.8), (r"\bpricing\b", 0.6), (r"\bworth (it|the money)\b", 0.6),
        (r"\bwhich (tool|product|plan) should i\b", 0.7),
    ],
    "summarization": [
        (r"\bsummari[sz]e\b", 1.0), (r"\btl;?dr\b", 0.8), (r"\bkey (points|takeaways)\b", 0.6),
        (r"\bin short\b", 0.4),
    ],
}
INTENT_SIGNALS = {
    "learn": [(r"\blearn\b", 1.0), (r"\bunderstand\b", 0.7), (r"\bhow does .* work\b", 0.8), (r"\bteach me\b", 0.9)],
    "build": [(r"\bbuild\b", 1.0), (r"\bimplement\b", 0.8), (r"\bset up\b", 0.5), (r"\bdevelop\b", 0.6),
              (r"\bwrite (a|the) code\b", 0.6)],
    "debug": [(r"\bdebug\b", 1.0), (r"\bfix\b", 0.8), (r"\berror\b", 0.6), (r"\bbug\b", 0.7),
              (r"\bnot working\b", 0.6), (r"\bcrash\w*\b", 0.6)],
    "compare": [(r"\bcompare\b", 1.0), (r"\bvs\.?\b", 0.8), (r"\bversus\b", 0.8), (r"\bdifference between\b", 0.8),
                (r"\bwhich is better\b", 0.7)],
    "brainstorm": [(r"\bbrainstorm\b", 1.0), (r"\bideas?\b", 0.5), (r"\bwhat if\b", 0.4), (r"\bcome up with\b", 0.5)],
    "plan": [(r"\bplan\b", 1.0), (r"\broadmap\b", 0.7), (r"\bstrategy\b", 0.6), (r"\bnext steps?\b", 0.5),
             (r"\bschedule\b", 0.4)],
    "purchase": [(r"\bbuy\b", 1.0), (r"\bpurchase\b", 1.0), (r"\bpricing\b", 0.6), (r"\bsubscri\w*\b", 0.5)],
    "summarize": [(r"\bsummari[sz]e\b", 1.0), (r"\btl;?dr\b", 0.9), (r"\bkey points\b", 0.6), (r"\bshorten\b", 0.5)],
    "explain": [(r"\bexplain\b", 1.0), (r"\bwhat is\b", 0.5), (r"\bwhy\b", 0.4), (r"\bclarify\b", 0.6)],
    "create": [(r"\bcreate\b", 1.0), (r"\bgenerate\b", 0.7), (r"\bwrite (a|an)\b", 0.6), (r"\bdraft\b", 0.5)],
    "optimize": [(r"\boptimi[sz]e\b", 1.0), (r"\bimprove\b", 0.6), (r"\bfaster\b", 0.5), (r"\breduce\b", 0.4),
                 (r"\bperformance\b", 0.5)],
    "research": [(r"\bresearch\b", 1.0), (r"\binvestigate\b", 0.7), (r"\bfind out\b", 0.5), (r"\blook into\b", 0.5)],
    "evaluate": [(r"\bevaluate\b", 1.0), (r"\bassess\b", 0.7), (r"\breview\b", 0.5), (r"\bworth (it|doing)\b", 0.5),
                 (r"\bpros and cons\b", 0.6)],
}
GOAL_KNOWLEDGE = {
    "system_design": ["architecture", "scalability", "databases", "distributed_systems", "backend_engineering"],
    "interview_preparation": ["technical_fundamentals", "communication_style", "past_experience", "backend_engineering"],
    "debugging": ["technical_fundamentals", "past_experience", "tooling"],
    "learning": ["technical_fundamentals", "communication_style"],
    "career_planning": ["goals", "values", "past_experience"],
    "startup_ideation": ["goals", "interests", "builder_mindset"],
    "research": ["technical_fundamentals", "interests"],
    "code_review": ["technical_fundamentals", "communication_style"],
    "optimization": ["technical_fundamentals", "backend_engineering"],
    "purchase_decision": ["values", "interests"],
    "summarization": ["communication_style"],
    "general_assistance": ["communication_style"],
}
GOAL_STRATEGY = {
    "system_design": "Emphasize trade-offs, scalability, and architectural clarity.",
    "interview_preparation": "Focus on interview-oriented explanations that demonstrate depth quickly.",
    "debugging": "Focus on root-cause analysis and precise, actionable fixes.",
    "learning": "Build understanding incrementally, connecting new concepts to what the user already knows.",
    "career_planning": "Ground advice in the user's demonstrated goals and track record.",
    "startup_ideation": "Encourage creative, opportunity-focused thinking grounded in the user's technical strengths.",
    "research": "Present balanced trade-offs and cite the reasoning behind conclusions.",
    "code_review": "Be direct about issues while explaining the reasoning behind each suggestion.",
    "optimization": "Quantify trade-offs and prioritize the highest-impact change first.",
    "purchase_decision": "Weigh cost against the user's stated priorities.",
    "summarization": "Prioritize brevity and the most decision-relevant points.",
    "general_assistance": "Provide clear, directly useful reasoning toward the user's goal.",
}
# (query trigger, topics a good answer touches)
TOPIC_EXPECTATIONS = [
    (r"\bcach(e|ing)\b", ["consistency", "replication", "partition tolerance", "cap theorem", "eviction policy", "ttl"]),
    (r"\bdistributed system(s)?\b|\bdistributed\b",
     ["consistency", "replication", "partition tolerance", "cap theorem", "consensus"]),
    (r"\bdatabase(s)?\b|\bdb\b", ["indexing", "normalization", "sharding", "replication", "acid"]),
    (r"\binterview(s|ing)?\b", ["data structures", "algorithms", "system design", "behavioral questions"]),
    (r"\bownership\b|\brust\b", ["ownership", "borrowing", "lifetimes", "traits", "memory safety"]),
    (r"\bmicroservices?\b", ["service discovery", "api gateway", "circuit breaker", "observability"]),
    (r"\bauth(entication|orization)?\b", ["oauth", "jwt", "session management", "rbac"]),
    (r"\bqueue(s|ing)?\b|\bmessag(e|ing) (broker|queue)\b",
     ["delivery guarantees", "ordering", "backpressure", "dead letter queue"]),
    (r"\bload balanc\w*\b", ["health checks", "routing algorithms", "sticky sessions"]),
]
MAX_MISSING_TOPICS = 5

# ---- stances, concept groups, traits (fixed values) ------------------------
STANCE_BUCKETS = {
    "preference": ["prefers", "prefer", "preferred"],
    "liking": ["likes", "like", "liked"],
    "want": ["wants", "want", "wanted"],
    "usage": ["uses", "use", "using", "used", "builds everything in", "builds with", "codes in", "develops in",
              "works primarily in"],
    "choice": ["chooses", "choose", "chose", "switched to", "moved to", "adopted"],
    "favor": ["favors", "favor", "favours", "favour"],
}
STANCE_TYPES = ["identity", "semantic", "procedural"]
DUPLICATE_TYPES = ["semantic", "concept", "episodic"]
CONTEXT_MERGE_TYPES = ["concept", "semantic"]
CONCEPT_GROUPS = {
    "ai_ml": ["artificial intelligence", "machine learning", "ai", "ml", "neural", "deep learning", "gpt"],
    "systems": ["system design", "systems", "architecture", "scalability", "distributed"],
    "infrastructure": ["kubernetes", "docker", "cloud", "infrastructure", "deployment", "devops"],
    "startup": ["startup", "founder", "venture", "capital", "funding", "vc", "entrepreneur"],
    "optimization": ["optimize", "performance", "speed", "latency", "throughput", "efficient"],
    "learning": ["learn", "study", "education", "course", "skill", "improve"],
    "career": ["career", "job", "role", "position", "promotion", "advancement"],
}
HIGHER_ORDER_PATTERNS = [
    ("systems_engineering_interest",
     ["distributed systems", "operating systems", "systems programming", "concurrency", "kernel", "rust", "backend",
      "low-level", "memory management"], 3),
    ("ai_infrastructure_interest",
     ["machine learning", "inference", "llm", "model serving", "gpu", "training", "neural network",
      "ai infrastructure"], 3),
    ("product_builder_mindset", ["startup", "product", "mvp", "shipping", "launch", "customer", "founder"], 2),
    ("data_engineering_interest",
     ["data pipeline", "etl", "data warehouse", "sql", "database", "analytics", "big data"], 3),
    ("frontend_engineering_interest",
     ["react", "frontend", "ui", "css", "javascript", "typescript", "component"], 3),
    ("security_engineering_interest",
     ["security", "encryption", "authentication", "vulnerability", "penetration testing", "threat model"], 2),
]
PATTERN_MIN_EVIDENCE = 0.55
TRAIT_VALUES = {
    "goal": ["become_staff_engineer", "build_startup", "learn_ai_systems", "improve_dsa",
             "software_engineering_growth", "leadership", "technical_excellence", "startup_creation"],
    "interest": ["ai", "infrastructure", "startups", "backend_engineering", "databases", "distributed_systems",
                 "systems_design", "cloud_computing", "machine_learning", "nlp"],
    "communication": ["concise", "detailed", "technical", "visual", "exploratory", "storytelling", "direct",
                      "socratic"],
    "behavior": ["high_curiosity", "ambitious", "analytical", "experimental", "persistent", "risk_tolerant",
                 "methodical", "creative", "builder", "learner", "explorer"],
    "value": ["continuous_learning", "speed", "excellence", "innovation", "independence", "collaboration",
              "reliability", "simplicity"],
    "skill": ["backend_engineering", "frontend_development", "devops", "data_engineering", "system_design",
              "python", "golang", "rust", "java", "distributed_systems", "databases", "ai_ml",
              "cloud_architecture"],
}
TRAIT_CATEGORIES = {"goals": "goal", "interests": "interest", "communication": "communication",
                    "behaviors": "behavior", "values": "value", "skills": "skill"}
TRAIT_TYPE_WEIGHT = {"goal": 1.0, "value": 0.9, "behavior": 0.8, "interest": 0.7, "communication": 0.6, "skill": 0.5}
TRAIT_QUERY_WORDS = {
    "goal": ["help", "build", "improve", "learn", "achieve"],
    "interest": ["interested", "curious", "about", "topic"],
    "skill": ["can", "know", "expertise", "use", "implement"],
    "behavior": ["usually", "typically", "tend", "prefer"],
    "communication": ["explain", "describe", "tell", "ask", "understand"],
    "value": ["important", "matter", "believe", "value"],
}
OPPOSING_VALUES = [("independence", "collaboration"), ("speed", "excellence"), ("innovation", "stability"),
                   ("specialization", "generalization"), ("risk_tolerant", "methodical")]
STYLE_INSTRUCTIONS = {
    "concise": "Keep response concise and direct.",
    "detailed": "Provide comprehensive details and examples.",
    "technical": "Use technical terminology and system-level details.",
    "visual": "Include diagrams or visual representations if possible.",
    "exploratory": "Encourage exploration and open-ended thinking.",
}
TRAIT_INSTRUCTIONS = {
    "high_curiosity": "Satisfy curiosity with deeper explanations.",
    "analytical": "Focus on logical reasoning and analysis.",
    "experimental": "Include novel approaches and experiments.",
    "practical": "Focus on practical implementation.",
    "ambitious": "Challenge assumptions and aim high.",
}
DEFAULT_INSTRUCTION = "Provide helpful context-appropriate response."

# ---- world model (fixed values) --------------------------------------------
TECHNOLOGY = {
    "fastapi": "FastAPI", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "pgvector": "pgvector",
    "redis": "Redis", "celery": "Celery", "python": "Python", "rust": "Rust", "typescript": "TypeScript",
    "javascript": "JavaScript", "react": "React", "vue": "Vue", "angular": "Angular", "docker": "Docker",
    "kubernetes": "Kubernetes", "sqlalchemy": "SQLAlchemy", "alembic": "Alembic", "pydantic": "Pydantic",
    "graphql": "GraphQL", "grpc": "gRPC", "kafka": "Kafka", "elasticsearch": "Elasticsearch",
    "mongodb": "MongoDB", "mysql": "MySQL", "sqlite": "SQLite", "nginx": "Nginx", "terraform": "Terraform",
    "openai": "OpenAI", "anthropic": "Anthropic", "langchain": "LangChain", "pytorch": "PyTorch",
    "tensorflow": "TensorFlow", "numpy": "NumPy", "networkx": "NetworkX", "node.js": "Node.js",
    "nodejs": "Node.js", "next.js": "Next.js", "django": "Django", "flask": "Flask", "golang": "Go",
    "java": "Java", "c++": "C++", "celery beat": "Celery",
}
SERVICE = {
    "aws": "AWS", "gcp": "GCP", "azure": "Azure", "github": "GitHub", "gitlab": "GitLab", "vercel": "Vercel",
    "heroku": "Heroku", "cloudflare": "Cloudflare", "stripe": "Stripe", "twilio": "Twilio",
    "datadog": "Datadog", "sentry": "Sentry", "netlify": "Netlify",
}
DEVICE = {
    "macbook": "MacBook", "iphone": "iPhone", "linux": "Linux", "macos": "macOS", "windows": "Windows",
    "ubuntu": "Ubuntu", "vs code": "VS Code", "vscode": "VS Code", "vim": "Vim", "neovim": "Neovim",
    "pycharm": "PyCharm", "intellij": "IntelliJ", "xcode": "Xcode", "cursor": "Cursor",
}
ENTITY_VOCABULARY = {"technology": TECHNOLOGY, "service": SERVICE, "device": DEVICE}
VOCABULARY_CONFIDENCE = 0.8
# (entity type, pattern, confidence); only the trigger words ignore case
ENTITY_RULES = [
    ("project", r"\b(?i:building|started building|working on|created|creating|launched)\s+"
                r"([A-Z][\w\-]*(?:\s+[A-Z][\w\-]*){0,3})", 0.75),
    ("project", r"\b([A-Z][\w\-]{2,30})\s+(?i:uses|stores|depends on|migrates to|is built with|builds|runs on|"
                r"is deployed to)\b", 0.5),
    ("task", r"\b(?i:i'?ll|i will|need to|todo:?|going to)\s+([a-zA-Z][^.!?\n]{3,60})", 0.5),
    ("meeting", r"\b(?i:meeting|call)\s+(?i:with)\s+([A-Z][\w]*(?:\s+[A-Z][\w]*)?)", 0.6),
    ("person", r"\b(?i:with|from)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)\b", 0.35),
    ("repository", r"\b([\w\-]+/[\w\-]+)\s+(?i:repo(?:sitory)?)\b|\b(?i:repo(?:sitory)?)\s+([\w\-]+/[\w\-]+)", 0.6),
    ("goal", r"\b(?i:goal is to|planning to|aiming to|my goal:?)\s+([a-zA-Z][^.!?\n]{3,80})", 0.55),
    ("document", r"\b([A-Z][\w\-]*\.md|(?i:README)(?:\.md)?)", 0.5),
    ("company", r"\b(?i:at)\s+([A-Z][\w]*(?:\s+[A-Z][\w]*)?)\s+(?i:Inc|Corp|LLC|Ltd)\b", 0.6),
]
RELATION_VERBS = [
    ("uses", [r"\buses?\b", r"\busing\b", r"\bbuilt with\b", r"\bpowered by\b"]),
    ("stores", [r"\bstores?\b", r"\bstoring\b", r"\bpersists?\b"]),
    ("depends_on", [r"\bdepends? on\b", r"\brequires?\b", r"\bneeds?\b"]),
    ("migrates_to", [r"\bmigrat\w* to\b", r"\bmoving to\b", r"\bswitch\w* to\b"]),
    ("deployed_to", [r"\bdeploy\w* (?:to|on)\b", r"\bhosted on\b", r"\brunning on\b"]),
    ("works_on", [r"\bwork\w* on\b", r"\bbuilding\b", r"\bdeveloping\b"]),
    ("blocks", [r"\bblocks?\b", r"\bblocked by\b", r"\bblocking\b"]),
    ("part_of", [r"\bpart of\b", r"\bwithin\b", r"\bbelongs to\b"]),
]
PHASE_PATTERN = (r"(?i)\b(?:currently|now)\s+(?:implementing|working on|building|on)\s+"
                 r"([A-Za-z][\w\s]{2,40}?)(?:[.!?\n]|$)")
NEXT_STEP_PATTERN = r"(?i)\b(?:next(?: step| up| goal)?|then)\s*(?:is|will be|:)?\s+([A-Za-z][^.!?\n]{2,80})"
STATUS_PATTERNS = [
    ("paused", [r"\bpaus(?:e|ed|ing)\b", r"\bon hold\b"]),
    ("completed", [r"\b(?:completed|finished|shipped|done)\b"]),
    ("archived", [r"\barchiv(?:e|ed|ing)\b", r"\babandon(?:ed|ing)?\b"]),
]
DECISION_PATTERNS = [
    ("postponed", r"([A-Za-z][^.!?\n]{3,100}?\s+(?:postponed|deferred|delayed))"),
    ("decided", r"(?:i\s+)?decided\s+to\s+([a-zA-Z][^.!?\n]{3,100})"),
    ("decided", r"(?:we'?ll|i'?ll)\s+(?:migrate|move|switch)\s+"
                r"([a-zA-Z][^.!?\n]{3,100}?\s+(?:to|for)\s+[a-zA-Z][^.!?\n]{1,60})"),
    ("chosen", r"([A-Za-z][^.!?\n]{2,60}\s+instead of\s+[A-Za-z][^.!?\n]{2,60})"),
]
REASON_PATTERN = r"(?i)\b(?:because|since|reason(?:ing)?(?: is| being)?:?)\s+([a-zA-Z][^.!?\n]{3,150})"
DEPENDENCY_TYPES = ["uses", "depends_on", "stores", "deployed_to"]
STACK_EXPECTATIONS = [
    (["fastapi", "flask", "django"], ["testing", "ci/cd", "api documentation", "monitoring"]),
    (["postgresql", "mysql", "mongodb"], ["migrations", "backup strategy", "connection pooling"]),
    (["redis"], ["cache invalidation strategy", "eviction policy"]),
    (["docker", "kubernetes"], ["deployment pipeline", "health checks", "logging"]),
    (["react", "vue", "angular"], ["state management", "testing", "accessibility"]),
]
ENVIRONMENT_NAMES = {
    "databases": ("technology", ["postgresql", "mysql", "mongodb", "redis", "sqlite", "elasticsearch"]),
    "cloud_providers": ("service", ["aws", "gcp", "azure", "vercel", "heroku", "netlify", "cloudflare"]),
    "ide": ("device", ["vs code", "vim", "neovim", "pycharm", "intellij", "xcode", "cursor"]),
    "operating_system": ("device", ["macos", "windows", "ubuntu", "linux"]),
}

# ---- limits of the usage and refinement rules (fixed values) ---------------
MONTHLY_CAP, SIGNUPS_PER_DAY = 200, 5
SYNTHESIS_MIN, SYNTHESIS_MAX, SYNTHESIS_CONFIDENCE = 3, 6, 0.5
RETIRE_CONFIDENCE, RETIRE_DAYS = 0.15, 90
GENERALIZE_MIN_GROUP = 3
IDENTITY_SHIFT_MIN_RECENT, IDENTITY_SHIFT_CONFIDENCE = 3, 0.6
DEAD_NODE_CONFIDENCE = 0.1
REPLAY_BATCH = 100
FUTURE_WEAK_AT, FUTURE_WEAK_FACTOR = 0.25, 0.85
