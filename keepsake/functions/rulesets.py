"""Rule sets for the keyword enricher.

A rule set is an ordered list of categories; each has keyword regexes (one
point each when found, however often) and domain hints (two points each when
a link host equals the domain or ends with ``.domain``).  Category order breaks
score ties.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — the default category rules.  They must equal the original
# tool's rule list for identical categorisation, so they are stated verbatim,
# in their original order: (category, keyword patterns, domains).
# ---------------------------------------------------------------------------
DEFAULT_CATEGORIES = [
    ("IA & Machine Learning",
     [r"\bia\b", r"\bai\b", "llm", "gpt", "claude", "gemini", "openai", "anthropic",
      "machine learning", "aprendizaje", "deep learning", "neural", "modelo", "prompt",
      "agente", "agent", "rag", "embedding", "hugging ?face", "mistral",
      "stable diffusion", "midjourney"],
     ["huggingface.co", "openai.com", "anthropic.com"]),
    ("Programación & Dev",
     ["javascript", "typescript", "python", "react", "node", r"rust\b", "golang",
      r"\bgo\b", "código", "code", "programa", "developer", "framework", r"api\b",
      "backend", "frontend", "docker", "kubernetes", "css", "html", "sql", r"git\b",
      "open ?source", "librería", "library", "bug", "deploy"],
     ["github.com", "gitlab.com", "stackoverflow.com", "npmjs.com", "dev.to", "vercel.com"]),
    ("Economía & Finanzas",
     ["econom", "finanz", "mercado", "bolsa", "inflación", "tipos de interés", "banco",
      "inversión", "invertir", "acciones", "dividendo", "cripto", "bitcoin", "ethereum",
      "startup funding", "valoración", "pib", "déficit"],
     ["bloomberg.com", "ft.com", "cincodias.elpais.com", "expansion.com"]),
    ("Política & Actualidad",
     ["gobierno", "política", "elecciones", "ministr", "president", "congreso", "senado",
      r"ley\b", "parlamento", "psoe", r"\bpp\b", r"ue\b", "unión europea", "geopolít",
      "guerra", "ucrania", "gaza"],
     []),
    ("Ciencia & Salud",
     ["ciencia", "científic", "estudio", "investigación", "física", "biolog", "química",
      "astronom", "espacio", "nasa", "salud", "medicina", "clínic", "vacuna", "cerebro",
      "neurocienc"],
     ["nature.com", "science.org", "arxiv.org", "nih.gov"]),
    ("Diseño & UX",
     ["diseño", "design", r"\bux\b", r"\bui\b", "tipografía", "typography", "figma",
      "branding", "logo", "paleta", "interfaz", "interface", "usabilidad", "wireframe"],
     ["figma.com", "dribbble.com", "behance.net"]),
    ("Marketing & Redes",
     ["marketing", r"\bseo\b", r"\bsem\b", "growth", "audiencia", "engagement", "viral",
      "contenido", "content", "newsletter", "copywriting", "publicidad", r"ads\b",
      "campaña", "funnel", "conversión"],
     []),
    ("Periodismo & Medios",
     ["periodismo", "periodista", "noticia", "reportaje", r"medios\b", "redacción",
      "titular", "fake news", "desinformación", r"fact.?check", "editorial", "crónica"],
     ["elconfidencial.com", "elpais.com", "elmundo.es", "reuters.com", "apnews.com"]),
    ("Productividad & Herramientas",
     ["productividad", "herramienta", r"tool\b", r"app\b", "aplicación", "notion",
      "obsidian", "automatiz", "workflow", "flujo de trabajo", "plantilla", "template",
      "atajo", "hack", r"tip\b", "truco"],
     ["notion.so", "zapier.com"]),
    ("Cultura & Entretenimiento",
     ["película", "film", r"serie\b", "netflix", "música", "music", r"libro\b",
      r"book\b", "leer", r"arte\b", "museo", "videojuego", r"game\b", "gaming", "cultura",
      "documental"],
     ["youtube.com", "youtu.be", "spotify.com", "imdb.com"]),
    ("Deportes",
     ["fútbol", "futbol", "baloncesto", r"\bnba\b", r"liga\b", "champions", "tenis",
      "fórmula 1", r"\bf1\b", "motogp", "deporte", "partido", r"gol\b", "madrid", "barça",
      "barca"],
     ["marca.com", "as.com"]),
]
# Topic and single tag given to a post that no category matches (fixed value).
NO_CATEGORY = "Sin categoría"
# ---------------------------------------------------------------------------

# A small rule set of our own whose words occur in the generated test corpus
# (four languages, hosts under example.com/.org/.net).  Several categories
# tie on score, so category order is exercised.
SAMPLE_CATEGORIES = [
    ("English", [r"\bthe\b", r"with\b", "tion"], ["example.com"]),
    ("Français", [r"\ble\b", r"des\b", "eau"], ["example.org"]),
    ("Deutsch", [r"\bder\b", r"und\b", "sch"], ["example.net"]),
    ("Español", [r"\bel\b", r"que\b", "ción"], []),
    ("Mixed", [r"\ben\b", "ou"], []),
]


def rule_rows(categories) -> list[tuple[str, int, str, int, str]]:
    """Flatten categories to (category, ord, kind, seq, pattern) rows."""
    rows = []
    for ord_, (name, kws, doms) in enumerate(categories):
        for seq, k in enumerate(kws):
            rows.append((name, ord_, "kw", seq, k))
        for seq, d in enumerate(doms):
            rows.append((name, ord_, "dom", seq, d))
    return rows
