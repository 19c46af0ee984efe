"""Fixed values that must equal the reference's for identical results.

FIXED VALUES — word lists, patterns, label maps, sentinels and thresholds are
kept here together, as plain text in their natural order.  Operators take them
as parameters; these are only the defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: Spanish stopwords (Snowball list, as shipped with Spark's
# StopWordsRemover.loadDefaultStopWords("spanish"), 313 words).
SPANISH_STOPWORDS_TEXT = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí
porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos
uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él
tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú
te ti tu tus ellas nosotras vosostros vosostras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya
suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy
estás está estamos estáis están esté estés estemos estéis estén estaré estarás estará estaremos
estaréis estarán estaría estarías estaríamos estaríais estarían estaba estabas estábamos estabais
estaban estuve estuviste estuvo estuvimos estuvisteis estuvieron estuviera estuvieras estuviéramos
estuvierais estuvieran estuviese estuvieses estuviésemos estuvieseis estuviesen estando estado
estada estados estadas estad he has ha hemos habéis han haya hayas hayamos hayáis hayan habré habrás
habrá habremos habréis habrán habría habrías habríamos habríais habrían había habías habíamos
habíais habían hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras hubiéramos hubierais
hubieran hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos habidas soy
eres es somos sois son sea seas seamos seáis sean seré serás será seremos seréis serán sería serías
seríamos seríais serían era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera
fueras fuéramos fuerais fueran fuese fueses fuésemos fueseis fuesen sintiendo sentido sentida
sentidos sentidas siente sentid tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos
tengáis tengan tendré tendrás tendrá tendremos tendréis tendrán tendría tendrías tendríamos
tendríais tendrían tenía tenías teníamos teníais tenían tuve tuviste tuvo tuvimos tuvisteis tuvieron
tuviera tuvieras tuviéramos tuvierais tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen
teniendo tenido tenida tenidos tenidas tened
"""
SPANISH_STOPWORDS = tuple(SPANISH_STOPWORDS_TEXT.split())

# FIXED VALUES: domain words added to the stopwords of the requirement text (then folded).
REQUIREMENT_EXTRA_STOPWORDS = (
    'num', 'num_largo', 'fecha', 'fechas', 'email', 'url', 'largo',
    'enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio',
    'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre',
    'dia', 'dias', 'mes', 'meses', 'semana', 'semanas', 'momento',
    'favor', 'apoyo', 'ayuda', 'gracias', 'gracia', 'estimado', 'estimada', 'estimados',
    'hola', 'buen', 'bueno', 'buena', 'atencion',
    'cordial', 'amable', 'esperar', 'adjuntar', 'agradecer', 'agradecere',
    'atento', 'comentario', 'colaboracion', 'gentil',
    'cristian', 'orellana', 'quevedo', 'california', 'parque', 'ecuador',
    'empalme', 'pichincha', 'sur', 'riobamba', 'paseo', 'rubianes', 'patricio',
    'quito', 'regional', 'carlos', 'jorge', 'maria', 'ana', 'juan', 'jose',
    'luis', 'paulin', 'diego', 'rodriguez', 'shopping', 'daule', 'manta',
    'cuenca', 'centro', 'san', 'christian', 'veronica', 'moreno',
    'cliente', 'cuenta', 'banco', 'bancs', 'bancslink', 'banclink',
    'tcs', 'sistema', 'aplicativo', 'aplicacion', 'servicio', 'usuario',
    'solicitud', 'requerimiento', 'incidente', 'ticket', 'caso',
    'proceso', 'procesamiento', 'transaccion', 'operacion',
    'informacion', 'datos', 'dato', 'registro', 'archivo',
    'numero', 'numeros', 'valor', 'valores',
    'revision', 'revisiones', 'documento', 'formato',
    'notificacion', 'correo', 'portal', 'modulo',
    'dichas', 'dicho', 'dichos', 'mismo', 'misma', 'mismos', 'mismas',
    'siguiente', 'siguientes', 'anteriores', 'correspondiente',
    'algun', 'alguna', 'algunos', 'algunas', 'alguno',
    'segun', 'dos', 'tres', 'ningun', 'ninguna',
    'nombre', 'parte', 'generacion', 'obtencion', 'muchas',
    'opcion', 'observacion',
    'bien', 'dar', 'ver', 'presenta', 'actualmente', 'prueba',
    'confirmacion', 'perteneciente', 'gerente', 'autorizacion',
    'mall', 'rio', 'telefono', 'detallar', 'contener', 'solo',
    'desear', 'jefe', 'amablemente', 'hacia', 'via',
    'proyecto', 'suficiente', 'mejora', 'adjunta', 'adjunto',
)

# FIXED VALUES: greeting / thanks boilerplate removed from requirement text, in order.
BOILERPLATE_PATTERNS = (
    r'\brequerimientos?\s+de\s+informacion\s+relacionados?\s+a\s+bancs?\s+y\s+bancslinks?\b',
    r'\batencion\s+solicitudes?\s+bancs?\s+y\s+bancslinks?\b',
    r'\bestimad[oa]s?\b', r'\bbuen[oa]s?\s+d[ii]as?\b',
    r'\bbuen[oa]s?\s+tardes?\b', r'\bbuen[oa]s?\s+noches?\b',
    r'\bbuen\s+d[ii]a\b',
    r'^\s*estimad[oa]s?\b', r'^\s*buen[oa]s?\s+d[ii]as\b',
    r'^\s*buen[oa]s?\s+tardes\b', r'^\s*buen[oa]s?\s+noches\b',
    r'\bespero\s+se\s+encuentren\s+bien\b',
    r'\bpor\s+favor\b', r'\bfavor\b', r'\bfavor\s+con\b',
    r'\bsu\s+gentil\s+ayuda\b', r'\bsu\s+ayuda\b',
    r'\bsu\s+gentil\s+apoyo\b', r'\bsu\s+apoyo\b',
    r'\bgentil\s+apoyo\b', r'\bfavor\s+su\s+ayuda\b',
    r'\bpor\s+favor\s+su\s+ayuda\s+con\b', r'\bpor\s+favor\s+su\s+apoyo\s+con\b',
    r'\bpor\s+favor\s+apoyar\b', r'\bpor\s+favor\s+ayudar\b',
    r'\bsu\s+gentil\s+apoyo\s+con\b', r'\bsu\s+ayuda\s+con\b',
    r'\bapoyo\s+con\b', r'\bayuda\s+con\b',
    r'\batenta?\s+a\s+sus\s+comentarios\b', r'\bquedo\s+atent[oa]\b',
    r'\bde\s+antemano\b', r'\bles\s+agradezco\b',
    r'\bagradezco\s+su\s+ayuda\b',
    r'\bcordial(?:es)?\s+saludos\b', r'\bsaludos?\s+cordiales?\b',
    r'\bsaludos?\b', r'\bgracias\b', r'\badjunto\b',
    r'\besperar\s+se\s+encontrar\s+bien\b', r'\badjuntar\b',
    r'\bquedar\s+atent[oa]\b', r'\bcordial(?:es)?\s+saludo[s]?\b',
    r'\bgracia[s]?\b', r'\ble[s]?\s+agradecer\b',
    r'\bagradecer\s+su\s+ayuda\b',
    r'\batento?\s+a\s+su[s]?\s+comentario[s]?\b',
)
# FIXED VALUES: leading prepositions dropped after the boilerplate (alternation order kept).
LEADING_PREPOSITIONS = ('con', 'con el', 'con la', 'con los', 'con las', 'para', 'sobre',
                        'del', 'de la', 'de los', 'de las')
BOILERPLATE_PASSES = 6
PREPOSITION_PASSES = 4

# FIXED VALUES: plural -> singular class names.
PLURAL_TO_SINGULAR = {
    'cheques': 'cheque',
    'cuentas': 'cuenta',
    'activos': 'activo',
    'garantias': 'garantia',
    'inversiones': 'inversion',
    'sobregiros': 'sobregiro',
    'usuarios': 'usuario',
    'procesos': 'proceso',
    'clientes': 'cliente',
    'reportes online': 'reporte online',
    'reportes batch': 'reporte batch',
    'formas numeradas': 'forma numerada',
}
# FIXED VALUES: class placeholders that mean "not classified", and rare classes removed.
UNCLASSIFIED = 'sin_clasificar'
PLACEHOLDER_CLASSES = ('0', 'no aplica', 'pendiente')
RARE_CLASSES = ('cc-cancelacion batch', 'cc-evento-alerta')

# FIXED VALUES: sentinels of routing and labelling.
TURNO = 'TURNO'
TURNO_CLASS = 'turno'
SIN_CLASIFICACION = 'SIN_CLASIFICACION'
SIN_GRUPO = 'SIN_ASIGNAR_SIN_GRUPO'
SIN_MIEMBROS = 'SIN ASIGNAR (SIN MIEMBROS)'
NO_GROUP_FOUND = 'NO GROUP FOUND'
REVIEW_CLASS = 'revision'
UNKNOWN_LABEL = 'DESCONOCIDO'
STANDBY = 'Stand-by'
INACTIVE_TAG = '[INACTIVE]'

# FIXED VALUES: shift rules (compared after strip) and shift classes.
SHIFT_RULE_CATEGORY = 'Operación TI'
SHIFT_RULE_SUBCATEGORY = 'Batch'
SHIFT_RULE_CONTACT = 'Monitoreo'
SHIFT_CLASSES = ('trickle feed', 'reporte batch')

# FIXED VALUES: ticket states that close a ticket / count as resolved.
CLOSED_STATES = ('Resuelto', 'Cerrado')

# FIXED VALUES: workload and thresholds.
RESOLVED_WEIGHT = 0.5
RESOLVED_DAYS_WINDOW = 7
OVERLOAD_MARGIN = 3
PROBA_REVIEW_THRESHOLD = 0.40
SOFTMAX_REVIEW_THRESHOLD = 0.10
SEED = 42

# FIXED VALUES: text fields joined into the ticket text.
INCIDENT_FIELDS_SKIPNULL = ('u_subcategory_2', 'cmdb_ci_business_app', 'short_description',
                            'u_affected_user.title', 'u_affected_user.department',
                            'u_affected_user.company', 'location.cmn_location_type', 'description')
INCIDENT_FIELDS_FILL = ('short_description', 'description', 'u_subcategory', 'u_subcategory_2')

# Fixed values of update rows: tables and columns of the ticket system, the application and the state that are set.
INCIDENT_TABLE = "incident"
REQUIREMENT_TABLE = "sc_req_item"
NUMBER_COLUMNS = ("number", "Number", "id")
APPLICATION = "Bancs"
UPDATED_STATE = "2"
