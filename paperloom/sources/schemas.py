"""Fixed read schemas: nothing is inferred from data."""

from __future__ import annotations

SNAPSHOT = (
    "id string, submitter string, authors string, title string, comments string, `journal-ref` string, doi string, "
    "`report-no` string, categories string, license string, abstract string, "
    "versions array<struct<version:string,created:string>>, update_date string, authors_parsed array<array<string>>"
)
API_PAGE = (
    "total bigint, token string, data array<struct<paperId:string,title:string,abstract:string,venue:string,"
    "citationCount:int,publicationDate:string,fieldsOfStudy:array<string>,"
    "authors:array<struct<authorId:string,name:string>>>>"
)
ENRICHMENT = (
    "paperId string, references array<struct<paperId:string,title:string>>, openAccessPdf struct<url:string>, "
    "externalIds struct<DOI:string,ArXiv:string,CorpusId:bigint>, influentialCitationCount int, isOpenAccess boolean"
)
SEARCH_REQUEST = (
    "task_id string, query struct<queries:array<string>,authorName:string,publicationDate_start:string,"
    "publicationDate_end:string,search_paperIds:array<string>,peer_reviewed_only:boolean,preprint_only:boolean,"
    "venues:array<string>,citationCount:int>, user_id string, query_id string, notebook_id string, topK int, "
    "paperLock boolean"
)
CANCEL_REQUEST = "task_id string, query_id string"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
# Payload fields kept on paper rows and on chunk rows.
SHARED_PAYLOAD = (
    "paperId", "fieldsOfStudy", "venue", "venue_lower", "authorName", "citationCount", "influentialCitationCount",
    "isOpenAccess", "publicationDate", "publicationYear", "openAccessPdf", "doi",
)
CHUNK_PAYLOAD = (*SHARED_PAYLOAD, "text")
PAPER_PAYLOAD = (*SHARED_PAYLOAD, "title", "abstract", "main_text")
