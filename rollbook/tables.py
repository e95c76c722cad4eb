"""The registry's tables: keys, columns and references.

Types no query shows are text. Physical column order is not known, so the load
functions take a schema that overrides these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from rollbook.operators.delete import Reference

# Table and column names of the registry.

SCHOOL_KEY = ["sekolah_id"]
SCHOOL_UPDATES = [
    "nama",
    "npsn",
    "bentuk_pendidikan",
    "jenjang",
    "alamat_jalan",
    "kode_desa_kelurahan",
    "desa_kelurahan",
    "kode_kecamatan",
    "kecamatan",
    "kode_kabupaten",
    "kabupaten",
    "kode_provinsi",
    "provinsi",
    "kode_pos",
    "email",
    "kebutuhan_khusus",
    "status_sekolah",
    "sk_pendirian_sekolah",
    "tanggal_sk_pendirian",
    "status_kepemilikan",
    "yayasan",
    "sk_izin_operasional",
    "tanggal_sk_izin_operasional",
    "rekening_atas_nama",
    "mbs",
    "kode_registrasi",
    "npwp",
    "nm_wp",
    "keaktifan",
    "wilayah_terpencil",
    "wilayah_perbatasan",
    "wilayah_transmigrasi",
    "wilayah_adat_terpencil",
    "wilayah_bencana_alam",
    "wilayah_bencana_sosial",
    "partisipasi_bos",
    "akses_internet",
    "akses_internet_2",
    "akreditasi",
    "akreditasi_sp_tmt",
    "akreditasi_sp_sk",
    "luas_tanah_milik",
    "luas_tanah_bukan_milik",
    "angkatan_psp",
]

STAFF_KEY = ["ptk_id"]
STAFF_UPDATES = [
    "semester",
    "sekolah_id",
    "ptk_terdaftar_id",
    "nama",
    "nip",
    "jenis_kelamin",
    "tempat_lahir",
    "tanggal_lahir",
    "nik",
    "no_kk",
    "niy_nigk",
    "status_kepegawaian",
    "jenis_ptk",
    "pengawas_bidang_studi",
    "agama",
    "kewarganegaraan",
    "alamat_jalan",
    "rt",
    "rw",
    "nama_dusun",
    "kode_desa_kelurahan",
    "desa_kelurahan",
    "kode_kecamatan",
    "kecamatan",
    "kode_kabupaten",
    "kabupaten",
    "kode_provinsi",
    "provinsi",
    "kode_pos",
    "lintang",
    "bujur",
    "no_telepon_rumah",
    "email",
    "status_keaktifan",
    "sk_cpns",
    "tgl_cpns",
    "sk_pengangkatan",
    "tmt_pengangkatan",
    "lembaga_pengangkat",
    "pangkat_golongan",
    "sumber_gaji",
    "nama_ibu_kandung",
    "status_perkawinan",
    "npwp",
    "rekening_bank",
    "rekening_atas_nama",
    "tahun_ajaran",
    "jabatan_ptk",
]
STAFF_SHOWN = [
    "ptk_id",
    "nama",
    "semester",
    "nik",
    "nip",
    "jenis_ptk",
    "status_kepegawaian",
    "jabatan_ptk",
]
STAFF_STATISTICS = [
    "ptk_id",
    "sekolah_id",
    "kabupaten",
    "jenis_kelamin",
    "status_kepegawaian",
    "jenis_ptk",
    "jabatan_ptk",
]

CANDIDATE_KEY = ["no_ukg", "tahun"]
CANDIDATE_UPDATES = [
    "nama_lengkap",
    "no_hp",
    "nama_sekolah",
    "npsn_sekolah",
    "jenjang_sekolah",
    "provinsi_sekolah",
    "kota_kab_sekolah",
    "status_kesediaan",
    "waktu_isi_kesediaan",
    "kode_bs_ppg",
    "bidang_studi_ppg",
    "lptk",
    "status_plotting",
    "alasan",
    "status_konfirmasi_email",
    "waktu_konfirmasi_email",
    "email_konfirmasi",
    "tahap",
]

PARTICIPANT_COLUMNS = [
    "nama",
    "kabupaten",
    "instansi",
    "jabatan",
    "alamat",
    "jenjang",
    "peran",
]
PARTICIPANT_REQUIRED = ["kegiatan_id", "nama", "kabupaten", "instansi", "jabatan"]
PARTICIPANT_ROLE = "peserta"

ACTIVITY_STAGED = [
    "nama_kegiatan",
    "tanggal_mulai",
    "tanggal_selesai",
    "penanggung_jawab",
    "team_id",
    "tempat_pelaksanaan",
    "tahun",
    "sasaran_peserta",
    "total_peserta",
]
ACTIVITY_LISTED = [
    "id",
    "nama_kegiatan",
    "tanggal_mulai",
    "tanggal_selesai",
    "penanggung_jawab",
    "team_id",
    "tim",
    "tempat_pelaksanaan",
    "tahun",
    "sasaran_peserta",
    "total_peserta",
    "created_at",
    "created_by",
]

USER_LISTED = ["id", "nip", "nama", "role", "created_at", "updated_at"]
USER_REQUIRED = ["nip", "nama", "password"]
USER_ROLES = ["admin", "user"]
USER_ROLE = "user"


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


@dataclass(frozen=True)
class UpsertTable:
    """A table that files are merged into."""

    key: list[str]
    updates: list[str]
    schema: T.StructType


SCHOOLS = UpsertTable(SCHOOL_KEY, SCHOOL_UPDATES, _text_schema(SCHOOL_KEY + SCHOOL_UPDATES))
STAFF = UpsertTable(STAFF_KEY, STAFF_UPDATES, _text_schema(STAFF_KEY + STAFF_UPDATES))
CANDIDATES = UpsertTable(
    CANDIDATE_KEY,
    CANDIDATE_UPDATES,
    _text_schema(["no", *CANDIDATE_KEY, *CANDIDATE_UPDATES]),
)

PARTICIPANTS = (
    "peserta_id bigint, kegiatan_id int, nama string, kabupaten string, instansi string, "
    "jabatan string, alamat string, jenjang string, peran string"
)
ACTIVITIES = (
    "id bigint, users_id bigint, nama_kegiatan string, tanggal_mulai date, "
    "tanggal_selesai date, penanggung_jawab string, team_id int, tempat_pelaksanaan string, "
    "tahun int, sasaran_peserta int, total_peserta int, created_at timestamp, "
    "updated_at timestamp"
)
USERS = (
    "id bigint, nip string, nama string, password string, role string, "
    "created_at timestamp, updated_at timestamp"
)
PERMISSIONS = "id bigint, code string"
USER_PERMISSIONS = "user_id bigint, permission_id bigint"
TEAMS = "id bigint, nama_tim string"

# Deleting a user takes along its links and activities. Whether participants go
# with their activity is not known, so that reference is kept apart.
USER_REFERENCES = [
    Reference("user_permissions", "user_id", "users", "id"),
    Reference("kegiatan", "users_id", "users", "id"),
]
ACTIVITY_REFERENCES = [Reference("peserta", "kegiatan_id", "kegiatan", "id")]
SCHOOL_REFERENCES = [Reference("ptk", "sekolah_id", "data_sekolah", "sekolah_id")]
