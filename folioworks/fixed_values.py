"""Fixed values that results depend on: word lists, formats and limits."""

# Document types in the order they are tried, with words that tell them.
DOCUMENT_TYPES = {
    "contrat": ["contrat", "convention", "accord", "engagement"],
    "plan": ["plan", "schema", "schéma", "dessin", "croquis"],
    "facture": ["facture", "note de frais", "avoir"],
    "devis": ["devis", "estimation", "cotation"],
    "rapport": ["rapport", "étude", "analyse"],
    "compte-rendu": ["compte rendu", "compte-rendu", "cr", "procès-verbal", "pv"],
}
# Section types in the order of ties, with words that tell them.
SECTION_TYPES = {
    "financial": ["prix", "montant", "euros", "tva", "paiement", "€", "facture", "tarif", "coût", "somme"],
    "legal": ["article", "code civil", "loi", "décret", "condition", "juridique", "clause", "obligation", "droit"],
    "parties": ["réservant", "réservataire", "société", "siren", "parties", "représenté", "vendeur", "acquéreur"],
    "temporal": ["date", "délai", "trimestre", "achèvement", "livraison", "échéance", "durée", "période"],
    "technical": ["travaux", "construction", "immeuble", "bâtiment", "permis", "édifier", "technique", "ouvrage"],
    "risk": ["garantie", "risque", "assurance", "prévention", "responsabilité", "sinistre", "caution"],
    "description": ["projet", "programme", "résidence", "description", "désignation", "caractéristique", "situation"],
}
# French words that are no keywords.
STOPWORDS = [
    "être", "avoir", "faire", "cette", "tous", "dans", "pour", "avec", "sans", "plus", "sous", "entre", "après", "avant", "autre", "leurs", "notre",
    "votre", "celui", "celle", "ceux", "celles", "quel", "quelle", "quels", "quelles", "sont", "sera", "seront", "était", "étaient", "peut",
    "peuvent", "doit", "doivent", "leur", "elle", "elles", "nous", "vous", "dont", "mais", "donc", "aussi",
]
# Letters of keywords.
KEYWORD_LETTERS = "a-zàâäéèêëïîôùûüÿçæœ"
# Headings of tables of contents.
CONTENTS_HEADINGS = ["SOMMAIRE", "TABLE DES MATIERES", "TABLE DES MATIÈRES", "TABLE OF CONTENTS", "INDEX", "CONTENTS"]
# Words that are noise.
NOISE_WORDS = ["--", ":--", "|", "```", "***"]
# What a report says of an issue (%: its count or share), and what it recommends.
MESSAGES = {
    "no_sections": "Aucune section à évaluer",
    "noise": "%d patterns de bruit détectés (LaTeX, symboles corrompus)",
    "noise_ratio": "Ratio de bruit élevé : %s%%",
    "latex": "%d commandes LaTeX résiduelles détectées",
    "gibberish": "%d sections avec du texte incohérent",
    "no_outline": "Aucun plan hiérarchique détecté",
    "shallow": "Hiérarchie peu profonde (depth=%d)",
    "few_sections": "Trop peu de sections (%d), document mal découpé",
    "unusual_sections": "Nombre de sections inhabituel (%d)",
    "incoherent": "%d incohérences hiérarchiques",
    "title": "Titre manquant ou invalide",
    "type": "Type de document non identifié",
    "reference": "Référence du document manquante",
    "parties": "Aucune partie identifiée dans le document",
    "short": "%d sections trop courtes (<50 mots)",
    "long": "%d sections très longues (>500 mots)",
    "no_keywords": "%d sections sans mots-clés",
    "uneven": "Distribution très inégale des longueurs de sections",
    "few_keywords": "Faible densité d'information (avg %s mots-clés/section)",
    "unsorted": "Positions de sections non séquentielles",
    "breadcrumbs": "%d breadcrumbs invalides",
    "orphans": "%d sections sans parent valide",
    "siblings": "%d sections avec références siblings invalides",
}
RECOMMENDATIONS = {
    "ocr": "⚠️ Qualité OCR faible - envisager un retraitement avec de meilleurs paramètres",
    "structure": "⚠️ Structure mal détectée - vérifier le plan hiérarchique manuellement",
    "metadata": "⚠️ Métadonnées incomplètes - compléter manuellement le titre et la référence",
    "errors": "🔴 %d erreur(s) critique(s) détectée(s) - revue manuelle nécessaire",
    "warnings": "🟡 %d avertissements - vérifier les sections signalées",
    "short": "📝 Vérifier les sections courtes : %s",
    "none": "✅ Document bien traité - aucune action requise",
}
# The report on a document that cannot be scored.
FAILED = {"grade": "Erreur", "message": "Erreur lors du scoring: %s", "recommendation": "Erreur lors de l'évaluation - vérifier les logs"}

# Defaults, limits and thresholds.
DEFAULT_TYPE, GENERAL = "document", "general"
UNTITLED_DOCUMENT, UNTITLED_SECTION = "Document sans titre", "Section sans titre"
TOKEN_RATIO = 3.5
MAX_CHARS, MAX_TOKENS = 1500, 512
RATE_PER_MINUTE = 10
MIN_WORDS = 10
MIN_TEXT_CHARS = 50
HEADER_LINES = 50
CONSOLIDATE_OVER, SMALL_WORDS, MERGED_WORDS = 50, 50, 400
REPEATED_OVER, REPEATED_CHARS = 3, 5
KEYWORDS = 5
SAMPLES_KEPT = 1000
PROCESSOR_VERSION, OCR_ENGINE = "4.1", "pymupdf-paddleocr"
