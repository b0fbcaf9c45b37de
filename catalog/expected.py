"""Fixed values the DuckDB counterparts use.

They are stated here once more, apart from the library's own tables, so that a wrong value there
shows as a difference.
"""

CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
EMBEDDING_DIM = 384
SEVERITY_NEEDLES = (
    ('blocker', 'blocker'),
    ('critical', 'critical'),
    ('major', 'major'),
    ('normal', 'normal'),
    ('minor', 'minor'),
    ('trivial', 'trivial'),
    ('enhancement', 'enhancement'),
    ('feature', 'enhancement'),
)
SEVERITY_CUES = (
    ('blocker', ('blocker', 'showstopper', 'data loss', 'corruption')),
    ('critical', ('critical', 'crash', 'hang', 'deadlock', 'cannot start', 'unusable')),
    ('major', ('major', 'broken', 'fails', 'exception', 'error', 'regression')),
    ('minor', ('minor', 'cosmetic', 'typo', 'small')),
    ('trivial', ('trivial', 'nit')),
)
JIRA_SEVERITY_NAMES = {
    'blocker': 'blocker',
    'critical': 'critical',
    'major': 'major',
    'minor': 'minor',
    'trivial': 'trivial',
}
PRIORITY_NAMES = {
    'p1': 'P1',
    'p2': 'P2',
    'p3': 'P3',
    'p4': 'P4',
    'p5': 'P5',
    'highest': 'P1',
    'high': 'P2',
    'medium': 'P3',
    'normal': 'P3',
    'low': 'P4',
    'lowest': 'P5',
    'blocker': 'P1',
    'critical': 'P2',
    'major': 'P3',
    'minor': 'P4',
    'trivial': 'P5',
}
STATUS_NEEDLES = (
    ('unconfirmed', 'new'),
    ('new', 'new'),
    ('open', 'open'),
    ('in progress', 'in_progress'),
    ('in_progress', 'in_progress'),
    ('assigned', 'assigned'),
    ('reopened', 'reopened'),
    ('resolved', 'resolved'),
    ('verified', 'verified'),
    ('closed', 'closed'),
    ('done', 'closed'),
)
RESOLUTION_NEEDLES = (
    ('fixed', 'fixed'),
    ('done', 'done'),
    ('duplicate', 'duplicate'),
    ('wontfix', 'wontfix'),
    ("won't fix", 'wontfix'),
    ("won't do", 'wontfix'),
    ('invalid', 'invalid'),
    ('not a bug', 'invalid'),
    ('worksforme', 'worksforme'),
    ('works for me', 'worksforme'),
    ('cannot reproduce', 'worksforme'),
    ('incomplete', 'incomplete'),
)
SECTION_LABELS = {
    'summary': 'summary',
    'title': 'summary',
    'description': 'description',
    'steps to reproduce': 'steps_to_reproduce',
    'steps': 'steps_to_reproduce',
    'reproduction': 'steps_to_reproduce',
    'how to reproduce': 'steps_to_reproduce',
    'expected': 'expected',
    'expected behavior': 'expected',
    'expected result': 'expected',
    'actual': 'actual',
    'actual behavior': 'actual',
    'actual result': 'actual',
    'observed': 'actual',
    'environment': 'environment',
    'system': 'environment',
    'platform': 'environment',
    'version': 'version',
    'severity': 'severity',
    'priority': 'priority',
}
RECORDS_PER_SOURCE = 3000
