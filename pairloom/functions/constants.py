"""Word lists, keyword rules and weights that results depend on."""

# fixed values: weights of the five requirement components
WEIGHTS = {"must_have": 0.45, "experience": 0.20, "responsibility": 0.15, "nice_to_have": 0.10, "domain": 0.10}

# fixed values: headings of candidate documents and of requirement texts
CV_HEADINGS = {
    "summary": ["summary", "profile", "objective", "apie mane", "santrauka"],
    "skills": ["skills", "technical skills", "core skills", "competencies", "kompetencijos", "igudziai"],
    "experience": ["experience", "work experience", "employment", "professional experience", "patirtis", "darbo patirtis"],
    "education": ["education", "issilavinimas", "studies"],
    "projects": ["projects", "projektai", "portfolio"],
    "languages": ["languages", "kalbos"],
    "certifications": ["certifications", "certificates", "sertifikatai", "kursai"],
}
JD_HEADINGS = {
    "summary": ["about the role", "job description", "description", "overview", "apie pozicija"],
    "requirements": ["requirements", "required skills", "must have", "must-have", "what we expect", "candidate requirements", "reikalavimai", "butina"],
    "responsibilities": ["responsibilities", "duties", "what you will do", "role responsibilities", "atsakomybes", "darbo pobudis"],
    "nice_to_have": ["nice to have", "preferred", "bonus", "advantage", "would be a plus", "privalumai", "privalumas"],
    "experience": ["experience", "seniority", "years of experience", "patirtis"],
    "offer": ["we offer", "benefits", "salary", "mes siulome"],
}

# fixed values: section of a requirement text to type of its requirements, in order
SECTION_TYPES = [("requirements", "must_have"), ("experience", "experience"), ("responsibilities", "responsibility"), ("nice_to_have", "nice_to_have"), ("summary", "domain")]

# fixed values: section pairs of the section-weighted embedding score (candidate view, requirement section)
SECTION_PAIRS = {
    "must_have": ("skills_experience", "requirements"), "experience": ("experience", "experience"), "responsibility": ("experience_projects", "responsibilities"),
    "nice_to_have": ("skills_experience", "nice_to_have"), "domain": ("relevant", "summary"),
}

# fixed values: markers of requirement sentences, words no token is made of
MARKERS = ["required", "must", "experience", "knowledge", "proficient", "skills", "ability", "butina", "patirtis", "moketi", "ismanyti"]
TOKEN_STOPS = ["and", "or", "the", "with", "for", "from", "have", "has", "must", "required", "knowledge", "experience", "skills", "ability", "work", "job", "team", "candidate", "you", "your"]
TERM_STOPS = ["also", "etc", "job", "work", "team", "candidate"]

# fixed values: names of the five percent bands
LABEL_NAMES = ["poor fit", "weak fit", "possible fit", "good fit", "strong fit"]

# fixed values: sections that make the views of a candidate document, and the scoring text of a requirement text
CV_VIEWS = {
    "relevant": ["summary", "skills", "experience", "projects", "certifications"],
    "skills_experience": ["skills", "experience", "projects"],
    "experience_projects": ["experience", "projects"],
}
JD_VIEW = ["summary", "requirements", "responsibilities", "nice_to_have", "experience"]

# fixed values: quality configurations (fewest, target and most words) and markers
QUALITY = {"jd": (80, 450, 1200), "title_jd": (60, 420, 1200), "cv": (180, 850, 3000)}
JD_MARKERS = ["requirements", "responsibilities", "qualifications", "experience", "skills", "preferred", "benefits", "duties", "must", "required", "education"]
CV_MARKERS = ["experience", "skills", "education", "summary", "projects", "certifications", "responsibilities", "accomplishments", "work experience"]

# fixed values: occupation groups by keyword, in order
JOB_GROUPS = [
    ("Technology", ["software", "developer", "programmer", "database", "network", "it ", "systems", "web", "data", "cloud", "security analyst"]),
    ("Healthcare", ["medical", "health", "nurse", "clinical", "patient", "dental", "pharmacy", "therapist"]),
    ("Finance", ["finance", "accounting", "accountant", "bank", "mortgage", "insurance", "payroll", "tax"]),
    ("Sales", ["sales", "retail", "account executive", "business development", "store"]),
    ("Marketing", ["marketing", "brand", "product marketing", "public relations", "social media"]),
    ("Operations", ["operations", "program management", "project management", "business strategic", "manager"]),
    ("Manufacturing", ["manufacturing", "production", "quality", "warehouse", "assembly"]),
    ("Logistics", ["logistics", "transportation", "driver", "shipping", "supply chain"]),
    ("Customer Support", ["customer support", "client care", "call center", "customer service"]),
    ("Hospitality", ["food", "hospitality", "restaurant", "chef", "hotel"]),
    ("Engineering", ["engineering", "mechanical", "electrical", "civil", "structural"]),
    ("Construction", ["construction", "skilled trades", "building"]),
    ("Education", ["education", "training", "teacher", "instruction"]),
    ("Legal", ["legal", "paralegal", "attorney", "law"]),
    ("Human Resources", ["human resources", "recruiting", "recruiter", "hr "]),
    ("Administrative", ["administrative", "clerical", "data entry", "office assistant"]),
    ("Science", ["science", "biotech", "laboratory", "r&d", "research"]),
    ("Security", ["protective services", "security guard", "public safety"]),
    ("Creative Media", ["creative", "design", "editorial", "writing", "media"]),
]
RESUME_GROUPS = [
    ("Data and Database", ["database", "data analyst", "data scientist", "business intelligence"]),
    ("Software Development", ["software", "developer", "java", "python", "web", "front end", "backend", "full stack", "ios"]),
    ("Infrastructure and Systems", ["systems", "network", "administrator", "devops", "cloud"]),
    ("Cybersecurity", ["security", "cyber"]),
    ("Project Management", ["project manager", "program manager", "scrum", "product manager"]),
]

# fixed values: candidate types and how many of each a requirement text gets
PAIR_TYPES = ["likely_good", "medium", "hard_negative", "random_negative"]
PAIR_COUNT = 5
METHODS = ["tfidf", "bge", "e5", "gte", "sbert", "section", "requirement", "llm"]

# fixed values: résumé groups for the titles of technology jobs (first match), for other groups, and the pools between
TECH_TITLES = [
    (["database", "data", "machine learning", "analyst"], ["Data and Database", "Software Development", "Information Technology"]),
    (["network", "systems", "devops", "administrator"], ["Infrastructure and Systems", "Data and Database", "Information Technology"]),
    (["security", "cyber"], ["Cybersecurity", "Infrastructure and Systems", "Information Technology"]),
    (["project", "product", "scrum"], ["Project Management", "Business Development", "Information Technology"]),
]
TECH_DEFAULT = ["Software Development", "Other Technology", "Information Technology"]
GROUP_POOLS = {
    "Healthcare": ["Healthcare"],
    "Finance": ["Finance", "Accountant", "Banking"],
    "Sales": ["Sales", "Business Development"],
    "Marketing": ["Public Relations", "Digital Media", "Business Development"],
    "Operations": ["Business Development", "Consultant", "Project Management"],
    "Manufacturing": ["Engineering", "Construction", "Automobile"],
    "Logistics": ["Aviation", "Automobile", "Business Development"],
    "Customer Support": ["Hr", "Sales", "Business Development"],
    "Hospitality": ["Chef", "Fitness"],
    "Engineering": ["Engineering", "Construction"],
    "Construction": ["Construction", "Engineering"],
    "Education": ["Teacher", "Arts"],
    "Legal": ["Advocate"],
    "Human Resources": ["Hr", "Business Development"],
    "Administrative": ["Business Development", "Hr"],
    "Science": ["Healthcare", "Agriculture", "Engineering"],
    "Security": ["Cybersecurity", "Information Technology"],
    "Creative Media": ["Designer", "Arts", "Digital Media"],
}
POOL_DEFAULT = ["Business Development", "Consultant", "Sales"]
MEDIUM_TECH = ["Software Development", "Data and Database", "Infrastructure and Systems", "Cybersecurity", "Project Management", "Other Technology", "Information Technology"]
MEDIUM_OTHER = ["Business Development", "Consultant", "Sales", "Project Management", "Other Technology"]
