"""Word lists, weights and limits the rules depend on.

Everything here is a fixed value: changing one changes results. Lists that users are expected to
replace (section headers, action verbs, injection patterns) are only defaults of operator arguments.
"""

# --- fixed values: text -------------------------------------------------------------------------

PROTECTED_TOKENS = [
    "asp.net", "node.js", "next.js", "vue.js", "objective-c",
    ".net", "ci/cd", "c++", "c#", "f#",
]

STEM_SUFFIXES = [
    "amientos", "imientos", "amiento", "imiento", "aciones", "iciones",
    "idades", "logias",
    "acion", "icion", "ables", "ibles", "ancia", "encia", "mente",
    "ando", "iendo", "ados", "idos", "amos", "emos", "imos", "aron", "ieron",
    "ado", "ido", "ora", "ores", "oras",
    "ar", "er", "ir", "or", "as", "os", "es", "an", "en",
    "a", "o", "e", "s",
]

MIN_STEM = 3
MAX_HEADER_WORDS = 5
MAX_GRAM = 3

CV_HEADERS = {
    "experiencia": "experience",
    "experiencia laboral": "experience",
    "experiencia profesional": "experience",
    "trayectoria": "experience",
    "educacion": "education",
    "formacion": "education",
    "formacion academica": "education",
    "estudios": "education",
    "habilidades": "skills",
    "competencias": "skills",
    "conocimientos": "skills",
    "aptitudes": "skills",
    "skills": "skills",
    "tecnologias": "skills",
    "stack tecnologico": "skills",
    "perfil": "summary",
    "perfil profesional": "summary",
    "resumen": "summary",
    "sobre mi": "summary",
    "acerca de mi": "summary",
    "objetivo": "summary",
    "contacto": "contact",
    "datos de contacto": "contact",
    "idiomas": "languages",
    "proyectos": "projects",
    "certificaciones": "certifications",
    "certificados": "certifications",
    "cursos": "certifications",
}

JOB_HEADERS = {
    "requisitos": "must",
    "requerimientos": "must",
    "requisito": "must",
    "perfil": "must",
    "que buscamos": "must",
    "lo que buscamos": "must",
    "deseable": "nice",
    "deseables": "nice",
    "valoramos": "nice",
    "nice to have": "nice",
    "responsabilidades": "resp",
    "funciones": "resp",
    "actividades": "resp",
}

ACTION_VERBS = [
    "lidere", "liderar", "desarrolle", "desarrollar", "implemente", "implementar",
    "disene", "disenar", "optimice", "optimizar", "reduje", "reducir",
    "aumente", "aumentar", "construi", "construir", "gestione", "gestionar",
    "automatice", "automatizar", "migre", "migrar", "mejore", "mejorar",
    "coordine", "coordinar", "dirigi", "dirigir", "cree", "crear",
    "lance", "lanzar", "entregue", "entregar", "administre", "administrar",
    "integre", "integrar", "configure", "configurar", "analice", "analizar",
    "ejecute", "ejecutar", "lidero", "logre", "lograr",
]

PROMINENT_SECTIONS = ["skills", "summary", "certifications", "header"]

IMPORT_HEADERS = [
    "EXPERIENCIA", "EDUCACION", "EDUCACIÓN", "HABILIDADES",
    "PROYECTOS", "CONTACTO", "PERFIL", "RESUMEN",
    "IDIOMAS", "CERTIFICACIONES", "REFERENCIAS", "PUBLICACIONES",
    "EXPERIENCE", "EDUCATION", "SKILLS", "PROJECTS",
    "CONTACT", "PROFILE", "SUMMARY", "LANGUAGES",
    "CERTIFICATIONS", "REFERENCES", "PUBLICATIONS",
]

CONFUSABLE_TERMS = [
    ("java", "javascript"),
    ("c", "c#"),
    ("c", "c++"),
    ("c#", "c++"),
    ("react", "react native"),
    ("go", "mongo"),
    ("r", "ruby"),
    ("php", "perl"),
    ("scala", "java"),
    ("kotlin", "scala"),
]

INJECTION_PATTERNS = ["ignore previous", "system:", "<|im_start|>", "assistant:"]

# --- fixed values: entities ---------------------------------------------------------------------

ENTITY_SKILLS = [
    "C#", ".NET", "Java", "Python", "JavaScript", "TypeScript", "Node.js", "React", "Angular", "Vue",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "SQL", "PostgreSQL", "MongoDB", "Redis", "Git",
]

ENTITY_CERTIFICATIONS = [
    "AWS Certified Solutions Architect",
    "AWS Certified Developer",
    "AWS Solutions Architect",
    "AWS Developer",
    "PMP",
    "Scrum Master",
    "CSM",
    "PSM",
    "CISSP",
    "CKAD",
    "CKA",
    "OCP",
]

ENTITY_TITLES = ["Senior", "Junior", "Lead", "Principal", "Staff", "Manager", "Director", "Architect", "VP"]

# --- fixed values: weights ----------------------------------------------------------------------

SECTION_MULTIPLIER = {"must": 1.2, "title": 1.1, "resp": 1.0, "nice": 0.6}
CATEGORY_BASE = {"hard": 1.0, "tool": 0.9, "soft": 0.6, "generic": 0.5}
FUZZY_THRESHOLD = 0.92
