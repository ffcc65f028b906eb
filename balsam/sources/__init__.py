from balsam.sources.tables import table, labelled_documents, embedding_set
from balsam.sources.csv import read_csv, write_csv, normalise_na
